"""Byte-pair encoding and decoding with a public vocabulary file whose words
carry an end mark and whose white space is dropped.

Encoding: a text is normalised (NFC, white space to blanks, lower case),
split by the file's pattern into words, and every word's bytes are merged by
rank. Words are merged many at a time: all new words of equal length form a
matrix of parts with a matrix of the ranks of neighbouring parts. Each step
scans every row for its first least rank, deletes the boundary there and
refreshes the two neighbouring ranks; rows without a mergeable pair are done.
Words beyond ``SHORT`` bytes, where repeated scans would be quadratic, use
the same rule with a heap over linked parts.

Decoding: the file names no decoder, so tokens are joined by one blank.

Defined results: null and empty text have no ids and decode to the empty
text. The strings of special tokens in a text become their ids, as in the
library. Repeated rows get equal results. Long texts are encoded whole.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Bytes of a word up to which ranks are scanned.
SHORT = 128
#: Words kept by a task's cache, and new words merged at once.
CACHE, TOGETHER = 400_000, 50_000
NONE = np.int64(1 << 40)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """A printable letter for every byte (byte-level vocabularies): printable
    Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and pattern of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.any_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], np.int64)
        self.final = np.array([self.ids[c + self.suffix] for c in letters], np.int64)
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            rank.setdefault((self.ids[a], self.ids[b]), (r, self.ids[a + b]))
        keys = np.array([a * self.size + b for a, b in rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in rank.values()], np.int64)[order]
        self.merged = np.full(len(model["merges"]), -1, np.int64)
        for r, i in rank.values():
            self.merged[r] = i
        self.pairs = rank

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def words(self, text: str) -> list[str]:
        """Normalised words of a text without special tokens."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.pattern.findall(text.replace("Σ", "σ").lower())  # sigma by letter, whatever its place


def merge_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of every word, by the contiguous rank array."""
    out: list = [None] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, who in by_length.items():
        if n > SHORT:
            for i in who:
                out[i] = merge_long(v, words[i])
            continue
        at = np.array(who)
        raw = np.frombuffer(b"".join([words[i] for i in who]), np.uint8).reshape(len(who), n)
        parts = v.inner[raw]
        parts[:, -1] = v.final[raw[:, -1]]
        ranks = v.rank_of(parts[:, :-1], parts[:, 1:])
        while True:
            width = parts.shape[1]
            least = ranks.argmin(1) if width > 1 else np.zeros(len(at), int)
            low = ranks[np.arange(len(at)), least] if width > 1 else np.full(len(at), NONE)
            done = low == NONE
            for i, row in zip(at[done].tolist(), parts[done]):
                out[i] = row
            if done.all():
                break
            at, parts, ranks, least, low = at[~done], parts[~done], ranks[~done], least[~done], low[~done]
            rows = np.arange(len(at))
            parts[rows, least] = v.merged[low]
            stay = np.ones(parts.shape, bool)
            stay[rows, least + 1] = False  # the boundary between the two parts goes
            parts = parts[stay].reshape(len(at), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, least] = False
            ranks = ranks[stay].reshape(len(at), width - 2)
            left = least > 0
            ranks[rows[left], least[left] - 1] = v.rank_of(parts[rows[left], least[left] - 1], parts[rows[left], least[left]])
            right = least < width - 2
            ranks[rows[right], least[right]] = v.rank_of(parts[rows[right], least[right]], parts[rows[right], least[right] + 1])
    return out


def merge_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """The same rule for one long word: a heap of (rank, place) over linked parts."""
    ids = [int(v.inner[b]) for b in word[:-1]] + [int(v.final[word[-1]])]
    after, before, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
    heap = [(*v.pairs[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in v.pairs]
    heap = [(r, i, p) for r, _, i, p in heap]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if alive[i] else len(ids)
        if j >= len(ids) or (ids[i], ids[j]) != pair:
            continue  # one of the two was merged meanwhile
        ids[i], alive[j], after[i] = v.pairs[pair][1], False, after[j]
        if after[i] < len(ids):
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(ids) and (p := (ids[a], ids[after[a]])) in v.pairs:
                heapq.heappush(heap, (v.pairs[p][0], a, p))
    return np.array([x for x, ok in zip(ids, alive) if ok], np.int64)


class Codec:
    """Encoder and decoder of one vocabulary with a cache of chunks (text
    between white space, normalised) to ids and tokens as text."""

    #: White space of Python that the file's pattern does not know as such.
    NOT_BLANK = regex.compile("[\x1c-\x1f]")

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.words: dict[str, np.ndarray] = {}
        self.chunks: dict[str, tuple[str, str]] = {}

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        new = list(set(words) - self.words.keys())
        for i in range(0, len(new), TOGETHER):
            part = new[i:i + TOGETHER]
            self.words.update(zip(part, merge_words(self.v, [w.encode("utf-8") for w in part])))
        return [self.words[w] for w in words]

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text (the plain way; ``encode_all`` gives the same)."""
        out: list[int] = []
        for piece, special in self._pieces(text or ""):
            out += [special] if special is not None else [int(x) for w in self.encode_words(self.v.words(piece)) for x in w]
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.v.tokens[i] for i in ids])

    def _pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.v.any_special.finditer(text) if self.v.any_special else ():
            yield text[at:m.start()], None
            yield m.group(), self.v.special[m.group()]
            at = m.end()
        yield text[at:], None

    def encode_all(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by one blank, decoded text) per text."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        split: list[list[str] | None] = []
        for t in texts:
            plain = not (self.NOT_BLANK.search(t) or (self.v.any_special and self.v.any_special.search(t)))
            if plain and not unicodedata.is_normalized("NFC", t):
                t = unicodedata.normalize("NFC", t)
            split.append(t.replace("Σ", "σ").lower().split() if plain else None)
        new = list(set().union(*[s for s in split if s]) - self.chunks.keys())
        found = [self.v.pattern.findall(c) for c in new]
        self.words.clear()
        ids = iter(self.encode_words([w for f in found for w in f]))
        for c, f in zip(new, found):
            got = [x for _ in f for x in next(ids).tolist()]
            self.chunks[c] = (" ".join(map(str, got)), self.decode(got))
        out = []
        for t, s in zip(texts, split):
            if s is None:
                got = self.encode(t)
                out.append((" ".join(map(str, got)), self.decode(got)))
            else:
                pairs = [p for p in map(self.chunks.__getitem__, s) if p[0]]
                out.append((" ".join([p[0] for p in pairs]), " ".join([p[1] for p in pairs])))
        return out


def _encode_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = Codec(path)
    for b in C.sliced(batches):
        for i in range(0, b.num_rows, 128):
            part = b.slice(i, 128)
            got = codec.encode_all(C.texts(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([g[0] for g in got], pa.string()),
                                              pa.array([g[1] for g in got], pa.string())], ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array), decoded per row."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = d.mapInArrow(functools.partial(_encode_batches, path or default_vocabulary()), "doc_id long, ids string, decoded string")
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(F.split("ids", " ").cast("array<int>"))
    return out.select("doc_id", ids.alias("ids"), "decoded")


def _digest_batches(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    for b in _encode_batches(path, batches):
        ids, dec = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                                          pa.array(list(map(sha, ids)), pa.string()), pa.array(list(map(sha, dec)), pa.string())],
                                         ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, made inside the encoding task."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_digest_batches, path or default_vocabulary()),
                        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(C.table(spark, sf_dir, "documents"))
