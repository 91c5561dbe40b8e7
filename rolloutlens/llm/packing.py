"""Best-fit packing of token sequences: inside partitions, then over their bins.

Items are pieces of documents: a document longer than the capacity is cut
from its end into full pieces, so only its first piece may be shorter. Full
pieces are sequences of their own. The rest is packed in two steps:

 1. every partition best-fits its pieces, longest first;
 2. the bins of all partitions are best-fitted as items of fixed content.

Step 2 is exact over all bins, without any of them left out. Two bins of one
partition never fit together (the later one was opened by an item that did not
fit into the earlier one), so a partition has at most one bin that is half full
or less, and two bins over half full never fit together either. Best fit over
all bins therefore leaves the larger ones where they are and puts the small ones
(at most one per partition), the fullest first, into the tightest bin. For
that the larger bins need not move: one task sees the small bins and how many
larger bins there are of each fill, and says which place of a fill each small
bin goes to. The places are found by the partitions' counts of each fill.
No bin is split and no piece is dropped.

Defined results: null text is an empty document of one closing id. Repeated
rows are separate documents; their pieces are packed separately. An empty
table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .bpe import byte_letters

CAPACITY = 2048
#: Pieces that one task packs.
PIECES_PER_TASK = 40_000
#: Chunks kept by a task's token cache.
CACHE = 600_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# Fixed value: the split pattern of byte-level tokenizer files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteTokens:
    """ids of the tokenizer file as little-endian unsigned 32-bit bytes.

    The pattern joins a blank only with what follows it, so a text whose
    blanks are single and lie between non-blanks falls into chunks, each with
    its blank in front, that encode on their own. Chunks are cached; new Latin
    ones are encoded together by the same vocabulary read as ranks (a token
    that begins with the blank begins a chunk). Other chunks, and any other
    text whole, go to the tokenizers library.
    """

    def __init__(self, path: str):
        import os

        import tokenizers
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
        self.tok = tokenizers.Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}  # of a chunk that must not stand alone: b""
        self._read_ranks(path)

    def _read_ranks(self, path: str) -> None:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        pre = spec["pre_tokenizer"] or {}
        self.ranks = None
        if made == sorted(set(made)) and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") \
                and not pre.get("add_prefix_space"):  # ids in the order of merges: ids are ranks
            byte = {c: b for b, c in enumerate(byte_letters())}
            tokens = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
            self.ranks = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=tokens, special_tokens={})
            self.opens = np.zeros(max(vocab.values()) + 1, bool)
            self.opens[[i for t, i in tokens.items() if t[:1] == b" "]] = True

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: list[str]) -> None:
        together = []
        for c in chunks:
            if c.strip() != c or not c:
                self.cache[c] = b""
            elif self.ranks is not None and (c.isascii() or max(c) < "\u0250"):
                together.append(c)
            else:
                self.cache[c] = self.direct(" " + c).tobytes()
        for i in range(0, len(together), 4096):
            part = together[i:i + 4096]
            ids = np.asarray(self.ranks.encode_ordinary(" " + " ".join(part)), "<u4")
            at = np.append(np.nonzero(self.opens[ids])[0], len(ids))
            if len(at) != len(part) + 1:
                raise ValueError("the tokenizer file does not keep blanks at the beginning of words")
            raw = ids.tobytes()
            self.cache.update((c, raw[4 * x:4 * y]) for c, x, y in zip(part, at[:-1].tolist(), at[1:].tolist()))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        get, new, rows = self.cache.get, set(), []
        for t in texts:
            chunks = None if not t or any(s in t for s in self.special) else t.split(" ")
            if chunks is None or not chunks[0] or chunks[0][-1].isspace():
                rows.append((t, None, None))
                continue
            known = list(map(get, chunks[1:], repeat(None)))
            if None in known:
                new.update([c for c, k in zip(chunks[1:], known) if k is None])
            rows.append((t, chunks, known))
        self._learn(list(new))
        out = []
        for t, chunks, known in rows:
            if known is not None and None in known:
                known = [self.cache[c] if k is None else k for c, k in zip(chunks[1:], known)]
            whole = known is None or b"" in known
            out.append(self.direct(t).tobytes() if whole else self.direct(chunks[0]).tobytes() + b"".join(known))
        return out


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, counted from the end."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def _piece_batches(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, end = ByteTokens(path), np.asarray([end_id], "<u4").tobytes()
    for b in C.sliced(batches):
        rows = []
        for doc, ids in zip(b.column("doc_id").to_pylist(), enc(C.texts(b, "text"))):
            ids += end
            rows += [(doc, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                         ["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and then ``end_id``."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_piece_batches, path or default_vocabulary(), capacity, end_id), PIECE)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: bin and offset of every item, fill of every
    bin. Open bins lie in stacks by room; one integer has a bit for each room
    that some bin has, so the tightest bin is found without a scan."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill = 0, []
    for i in order.tolist():
        n = int(lengths[i])
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, k = capacity, len(fill)
            fill.append(0)
        where[i], offset[i] = k, fill[k]
        fill[k] += n
        left = room - n
        if left:
            by_room[left].append(k)
            rooms |= 1 << left
    return where, offset, np.asarray(fill, np.int64)


def _pack_batches(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, length in; item, bin, offset, fill of the bin, task out. A bin's
    number holds the task, so numbers never meet."""
    from pyspark import TaskContext
    got = [(b.column("item").to_numpy(zero_copy_only=False), b.column("length").to_numpy(zero_copy_only=False)) for b in batches]
    item, length = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in (0, 1))
    order = np.argsort(item, kind="stable")  # a task that runs again gets the same bins
    item, length = item[order], length[order]
    where, offset, fill = best_fit(length, capacity)
    task = TaskContext.get().partitionId()
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array((task << 32) + where, pa.int64()), pa.array(offset, pa.int64()),
                                      pa.array(fill[where] if len(where) else fill, pa.int64()), pa.array([task] * len(item), pa.int64())],
                                     ["item", "bin", "offset", "fill", "task"])


def join_small(small: list[tuple[int, int]], large: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int | None, int, int, int]]:
    """Best fit of the small bins (bin, fill) over all bins, where ``large``
    counts the others by fill. Of every small bin that moves: bin; the small bin
    it joins, or None and then the fill and the place (from 1) among the larger
    bins of that fill; its offset there."""
    count, used = dict(large), dict.fromkeys(large, 0)
    opened: dict[int, list[tuple]] = {}  # by room: bins that a small one has opened or joined
    rooms = sum(1 << (capacity - f) for f, n in count.items() if n and f < capacity)
    out = []
    for k, n in sorted(small, key=lambda x: (-x[1], x[0])):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            fill = capacity - room
            if opened.get(room):
                target = opened[room].pop()
            else:
                used[fill] += 1
                target = (None, fill, used[fill])
            if not opened.get(room) and used.get(fill, 0) == count.get(fill, 0):
                rooms &= ~(1 << room)
            out.append((k, *target, fill))
        else:
            room, target = capacity, (k, 0, 0)
        left = room - n
        if left:
            opened.setdefault(left, []).append(target)
            rooms |= 1 << left
    return out


MOVES = "bin long, to long, fill long, place long, shift long"


def _join_batches(capacity: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bin (null: larger bins of a fill), fill, n in; :data:`MOVES` out."""
    small, large = [], {}
    for b in batches:
        for k, f, n in zip(*(b.column(c).to_pylist() for c in ("bin", "fill", "n"))):
            if k is None:
                large[f] = n
            else:
                small.append((k, f))
    cols = list(zip(*join_small(small, large, capacity))) or [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bin", "to", "fill", "place", "shift"])


def _moves(level: DataFrame, capacity: int) -> DataFrame:
    """sequence_id, bin, shift: where the small bins of all tasks go."""
    bins = C.written(level.groupBy("task", "bin").agg(F.max("fill").alias("fill")), "packing-bins")
    small, large = bins.where(F.col("fill") * 2 <= capacity), bins.where(F.col("fill") * 2 > capacity)
    counts = C.written(large.groupBy("fill", "task").agg(F.count(F.lit(1)).alias("n")), "packing-counts")  # a row per task and fill
    seen = small.select("bin", "fill", F.lit(1).cast("long").alias("n")).unionByName(
        counts.groupBy("fill").agg(F.sum("n").alias("n")).withColumn("bin", F.lit(None).cast("long")).select("bin", "fill", "n"))
    moves = C.written(seen.repartition(1).mapInArrow(functools.partial(_join_batches, capacity), MOVES), "packing-moves")
    # the n-th bin of a fill: its task by the counts of the tasks before, then its place there
    before = Window.partitionBy("fill").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("fill", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    wanted = moves.where("to is null").select("fill", "place").distinct()
    wanted = wanted.join(begins, "fill").where("place > _before and place <= _before + n") \
        .select("fill", "place", "task", (F.col("place") - F.col("_before")).alias("_nth"))
    numbered = large.join(wanted.select("fill", "task").distinct(), ["fill", "task"]) \
        .withColumn("_nth", F.row_number().over(Window.partitionBy("fill", "task").orderBy("bin")).cast("long"))
    found = wanted.join(numbered, ["fill", "task", "_nth"]).select("fill", "place", F.col("bin").alias("_large"))
    return moves.join(found, ["fill", "place"], "left").select(
        F.col("bin").alias("sequence_id"), F.coalesce("to", "_large").alias("bin"), "shift")


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """items (item long, distinct; length) to item, sequence_id, offset."""
    items = items.select("item", "length")
    tasks = max(1, -(-items.count() // per_task))
    level = C.written(items.repartition(tasks, F.xxhash64("item")).mapInArrow(
        functools.partial(_pack_batches, capacity), "item long, bin long, offset long, fill long, task long"), "packing-0")
    result = level.select("item", F.col("bin").alias("sequence_id"), "offset")
    if tasks == 1:
        return result
    return result.join(_moves(level, capacity), "sequence_id", "left").select(
        "item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece."""
    numbered = pieces(docs, path, id_col, text_col, capacity).withColumn("item", F.monotonically_increasing_id())
    all_pieces = C.written(numbered, "packing-pieces")
    short = pack(all_pieces.where(F.col("length") < capacity), capacity)
    full = all_pieces.where(F.col("length") == capacity) \
        .select(*[F.col(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = all_pieces.where(F.col("length") < capacity).join(short, "item") \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    return full.unionByName(packed)


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(C.table(spark, sf_dir, "documents"))
