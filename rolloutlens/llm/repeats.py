"""Periodic run detection in the words of a text.

A run is a stretch of consecutive words with a smallest period q (words q apart
are identical), at least ``min_words`` words and ``min_exponent`` periods long,
that no neighbouring word extends. All runs of a text are found.

Method: an online sparse dynamic programme over diagonals. A diagonal is a lag;
at every word, an earlier occurrence at lag q raises the match length of
diagonal q by one if the word before raised it too, else starts it at one; a
diagonal that is not raised ends, and if its match is long enough it emits a
run there and then. What keeps the diagonals sparse: a frequent word has too
many earlier occurrences, and nearly all of them are in no run. So lags are
handled by levels, and at level l, for the lags in (l/2, l], an occurrence is
one of the l words from here on. Of these, only the latest earlier occurrence
counts: inside a run with smallest period q <= l, l words cannot recur nearer
than q (q would not be smallest), so the latest occurrence has lag q at every
word of the run from its second period on until l words before its end, and
another lag just before and after. So every stretch of words with the same lag
is one run in full, and every run with ``min_exponent`` >= 3 is one such stretch,
at one level. A level's blocks are pairs of the blocks of the level below;
blocks that occur once are dropped, so little is left after a few levels of
usual text. The cost is a sort of what is left per level: n log n for any text,
one word repeated n times included.

Texts are handled whole, many short ones at once (``SLICE_BYTES``), a long one
alone; memory is a constant times the longest text. No shuffle.

Defined results: null and empty texts have no words, no runs and collapse to
the empty text. Every row has its own result; ids are not compared, and may be
null or repeated. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20
#: Positions up to so many bits are sorted together with two block numbers in one 64-bit key.
PACKED = 20

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def split_words(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of the texts in order, and the places in them where a text begins and the last ends."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    inside = ~BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[:-1][bounds[:-1] < len(data)]
    first[begins] = inside[begins]  # a word ends where its text ends
    starts = np.flatnonzero(first)
    offsets = np.append(np.cumsum(inside, dtype=np.int64)[starts] - 1, np.count_nonzero(inside))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return words, np.searchsorted(starts, bounds)


def latest_occurrences(a: np.ndarray, b: np.ndarray, pos: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks named (a, b) at ascending positions below n. Positions sorted by
    block and place, whether the one before in that order is the same block,
    and a number for the block."""
    if n <= 1 << PACKED:
        key = np.sort((a << 2 * PACKED) | (b << PACKED) | pos)
        at, key = key & ((1 << PACKED) - 1), key >> PACKED
    else:
        key = a * n + b
        order = np.argsort(key, kind="stable")
        at, key = pos[order], key[order]
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    return at, same, np.cumsum(~same) - 1


def find_runs(word: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """word: a number below n for each of the n words of all texts; bounds: where texts begin, and n.
    Rows (start, length, period) by start and period, places counted over all texts."""
    n, sizes = len(word), np.diff(bounds)
    text, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(bounds[1:], sizes)
    size = np.repeat(sizes, sizes)
    pos = np.flatnonzero(size >= min_words)
    a, b, level, found = word[pos].astype(np.int64), text[pos], 1, []
    while len(pos):
        at, same, number = latest_occurrences(a, b, pos, n)
        lag = np.zeros(n, np.int64)
        lag[at[1:][same[1:]]] = (at[1:] - at[:-1])[same[1:]]
        # the diagonals of this level: a match goes on while the lag stays the same
        on = np.flatnonzero((lag > level // 2) & (lag <= level))
        if len(on):
            begins = np.flatnonzero(np.concatenate([[True], (np.diff(on) != 1) | (np.diff(lag[on]) != 0)]))
            period, match = lag[on[begins]], np.diff(np.append(begins, len(on)))
            length = match + level - 1 + period
            long = length >= np.maximum(min_words, min_exponent * period)
            found.append(np.stack([on[begins] - period, length, period], axis=1)[long])
        # blocks that occur again in their text make the blocks of twice the words
        again = same.copy()
        again[:-1] |= same[1:]
        block = np.full(n, -1, np.int64)
        block[at[again]] = number[again]
        pos = np.flatnonzero(block >= 0)
        pos = pos[(pos + 2 * level <= end[pos]) & (size[pos] >= min_exponent * (level + 1))]
        pos = pos[block[pos + level] >= 0]
        a, b, level = block[pos], block[pos + level], 2 * level
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _slices(texts: pa.LargeStringArray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SLICE_BYTES`` of text, or of one row."""
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLICE_BYTES, "right")) - 1)
        yield i, j
        i = j


def collapsed(words: pa.LargeStringArray, bounds: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Per text: its words but those after the first period of a run, joined by one space."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(step[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), words.filter(pa.array(kept)) if not kept.all() else words)
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def _detect(min_words: int, min_exponent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("id"), pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        for i, j in _slices(texts):
            words, bounds = split_words(texts.slice(i, j - i))
            number = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            runs = find_runs(number, bounds, min_words, min_exponent)
            cut = np.searchsorted(runs[:, 0], bounds)
            local = runs[:, 0] - np.repeat(bounds[:-1], np.diff(cut))
            spans = pa.StructArray.from_arrays([pa.array(local), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, j - i), pa.array(np.diff(bounds), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(cut, pa.int32()), spans), collapsed(words, bounds, runs)],
                ["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row: id, n_words, runs (start, length, period; by start, then
    period) and collapsed, the text without the repeats of its runs."""
    if min_exponent < 3 or min_words < 1:
        raise ValueError("runs of three periods or more, and of a word or more")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_detect, min_words, min_exponent),
                        "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def edited_text(doc_id: Column, text: Column) -> Column:
    """The texts that the query works on: of a tenth of the documents, by the
    checksum of the id, the words from one place on repeat with one period."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)  # below 2**29: exact
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))  # used only where there is a word
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    rewritten = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), rewritten).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", edited_text(F.col("doc_id"), F.col("text")).alias("text"))
    d = periodic_runs(docs)
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
                       lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    d = d.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                 F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period",
                    F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         xor(4294967295, list_reduce(list_transform(range(0, 8 * length(CAST(doc_id AS VARCHAR))),
               lambda i: CAST((ascii(substr(CAST(doc_id AS VARCHAR), CAST(i // 8 + 1 AS INTEGER), 1)) >> (i % 8)) & 1 AS BIGINT)),
             lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b)), 4294967295)) AS h
  FROM documents
), e AS (
  SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a,
         1 + (len(ws) - (h // 10) % greatest(len(ws), 1)) // (3 + (h // 10) % 8) AS p FROM d
), w AS (
  SELECT k, i, ws[CAST(CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END AS BIGINT) + 1] AS word, n
  FROM (SELECT *, unnest(range(0, n)) AS i FROM e)
), m AS (
  SELECT y.k, y.i, y.i - x.i AS q FROM w x JOIN w y ON x.k = y.k AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= y.n
), g AS (
  SELECT k, q, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g, i FROM m
), s AS (
  SELECT k, q, min(i) - q AS s, count(*) + q AS l FROM g GROUP BY k, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.k = s.k AND t.q < s.q AND s.q % t.q = 0 AND t.s <= s.s AND t.s + t.l >= s.s + s.l)
), b AS (
  SELECT k, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
         list(struct_pack(s := s, l := l, q := q) ORDER BY s, q) AS rs FROM r GROUP BY k
), f AS (
  SELECT *, list_reduce(rs, lambda x, y: CASE WHEN y.l * x.q > x.l * y.q THEN y ELSE x END) AS best FROM b
), c AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS kept FROM w
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.k = w.k AND w.i >= r.s + r.q AND w.i < r.s + r.l) GROUP BY k
)
SELECT d.doc_id, coalesce(f.n_runs, 0) AS n_runs, f.best.s AS start, f.best.l AS length, f.best.q AS period,
       (1000 * f.best.l) // f.best.q AS exponent_milli, sha256(coalesce(f.lines, '')) AS runs_sha256,
       sha256(coalesce(c.kept, '')) AS collapsed_sha256
FROM d LEFT JOIN f USING (k) LEFT JOIN c USING (k)
"""
