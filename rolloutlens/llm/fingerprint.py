"""Document fingerprints from prefix polynomial hashes.

A text's modular prefix array H, with H[i] = sum of c_j B^j over j < i, gives
the hash of any span in constant time, so two spans can be compared and the
longest common extension from two places is found by binary search. Two bases
modulo 2^31 - 1 make 62 bits.

A fingerprint is a string of hex digits: the hash of the whole text, its
length, and the ``KEEP`` smallest mixed hashes of all windows of ``WINDOW``
code points. Likeness of two fingerprints estimates the Jaccard index of the
texts' windows; it is exact when both texts have no more than ``KEEP``
different windows, else its standard error is at most 0.06 (64 window hashes).

Defined results: null and empty text are the empty text; two of them have
likeness 1, an empty and another text 0. A text shorter than a window is one
window. Equal texts have equal fingerprints and likeness 1. Rows are ordered
by id and then the hash of the text (xxhash64); null ids come last. The row after the last is the first,
so a single row is its own successor. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

PRIME = np.uint64(2**31 - 1)
SHIFT = np.uint64(31)
BASES = (1_000_003, 1_366_613_021)
WINDOW, KEEP = 16, 64


# ---- prefix hashes --------------------------------------------------------------------------------------------------

def mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for any unsigned 64-bit x."""
    for _ in range(3):
        x = (x & PRIME) + (x >> SHIFT)
    return np.where(x >= PRIME, x - PRIME, x)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int):
        self.step = [base, pow(base, -1, int(PRIME))]
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            by = [np.uint64(pow(s, k, int(PRIME))) for s in self.step]
            self.up = np.concatenate([self.up, mod(self.up * by[0])])
            self.down = np.concatenate([self.down, mod(self.down * by[1])])


_POWERS = tuple(map(_Powers, BASES))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class PrefixHash:
    """Prefix arrays of a text (as code points)."""

    def __init__(self, points: np.ndarray, start: "PrefixHash | None" = None, keep: int = 0):
        """With ``start``: the first ``keep`` code points of that text and then
        ``points``; the arrays up to there are shared."""
        self.n = keep + len(points)
        self.h = []
        c = points.astype(np.uint64) + np.uint64(1)  # a leading zero must count
        for k, p in enumerate(_POWERS):
            p.grow(self.n + 1)
            tail = np.cumsum(mod(c * p.up[keep:self.n]))
            if start is None:
                self.h.append(np.concatenate([np.zeros(1, np.uint64), mod(tail)]))
            else:
                self.h.append(np.concatenate([start.h[k][:keep + 1], mod(tail + start.h[k][keep])]))

    def spans(self, first: np.ndarray | slice, last: np.ndarray | slice) -> np.ndarray:
        """62-bit hashes of the spans [first, last)."""
        a, b = (mod(mod(h[last] + PRIME - h[first]) * p.down[:self.n + 1][first]) for h, p in zip(self.h, _POWERS))
        return a << SHIFT | b

    def span(self, first: int, last: int) -> int:
        """One span's hash, in plain integers (a binary search asks for many)."""
        out = 0
        for h, p in zip(self.h, _POWERS):
            out = out << 31 | (int(h[last]) - int(h[first])) * int(p.down[first]) % int(PRIME)
        return out

    def windows(self, size: int, since: int = 0) -> np.ndarray:
        """Hashes of all windows that start at ``since`` or later; a shorter text is one window."""
        if self.n < size:
            return self.spans(np.array([0]), np.array([self.n])) if self.n and not since else np.zeros(0, np.uint64)
        return self.spans(slice(since, self.n - size + 1), slice(since + size, self.n + 1))

    def extension(self, i: int, other: "PrefixHash", j: int) -> int:
        """Length of the longest common extension from i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.span(i, i + mid) == other.span(j, j + mid) else (low, mid - 1)
        return low


# ---- fingerprints ---------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """Upper 32 bits of a bijective mix, so that small values are a fair draw."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(32)).astype(np.uint32)


def smallest(values: np.ndarray, keep: int = KEEP) -> np.ndarray:
    """The ``keep`` smallest different values, sorted."""
    if len(values) > 8 * keep:
        few = np.unique(values[values < np.uint32(min(2**32 - 1, 4 * keep * 2**32 // len(values)))])
        if len(few) >= keep:
            return few[:keep]
    return np.unique(values)[:keep]


def render(p: PrefixHash, low: np.ndarray) -> str:
    return f"{p.span(0, p.n):016x}{p.n:08x}" + "".join([f"{v:08x}" for v in low.tolist()])


def fingerprint(text: str) -> str:
    p = PrefixHash(code_points(text))
    return render(p, smallest(mix(p.windows(WINDOW))))


def likeness(a: str, b: str, keep: int = KEEP) -> float:
    """0 to 1 from two fingerprints."""
    if a == b:
        return 1.0
    x, y = ({f[i:i + 8] for i in range(24, len(f), 8)} for f in (a, b))
    both = sorted(x | y)
    if len(x) >= keep or len(y) >= keep:  # the smallest of the union are known only as far as the sketches reach
        both = both[:keep]
    return sum(v in x and v in y for v in both) / len(both) if both else 0.0


# ---- each row and the next ------------------------------------------------------------------------------------------

def _deal(bounds: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bounds: the smallest (id, text hash) of every range. Rows to their
    range; a row that may be the first of its range also, as look-ahead, to
    the range before."""
    for b in batches:
        key = np.empty(b.num_rows, KEY)
        key["doc"], key["h"] = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "h"))
        at = np.searchsorted(bounds, key, side="right") - 1
        head = np.nonzero(bounds[at] == key)[0]
        _, first = np.unique(at[head], return_index=True)  # rows of one id and text are alike: one a batch will do
        head = head[first]
        names = ["bucket", "ahead", "doc", "h", "text"]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.zeros(b.num_rows, np.int32)), *(b.column(c) for c in names[2:])], names)
        if len(head):
            before = ((at[head] - 1) % len(bounds)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(before), pa.array(np.ones(len(head), np.int32)),
                                              *(b.column(c).take(pa.array(head)) for c in names[2:])], names)


KEY = np.dtype([("doc", np.int64), ("h", np.int64)])


def ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Rows dealt into ranges of (id, hash of the text), one range per
    partition, each sorted and followed by the first row of the next range:
    every row then sees its successor inside its task. An id that a third of
    the rows share fills many ranges, unless its texts are equal, too. Texts
    are shuffled once; the ranges come from a range partitioning of the ids
    and hashes alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.LAST_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = C.shuffle_partitions(docs.sparkSession)
    least = d.select("doc", "h").repartitionByRange(n, "doc", "h").groupBy(F.spark_partition_id().alias("p")) \
        .agg(F.min(F.struct("doc", "h")).alias("m")).collect()
    bounds = np.array(sorted({(r["m"]["doc"], r["m"]["h"]) for r in least}), KEY)  # a pair per partition
    if not len(bounds):
        return None
    dealt = d.mapInArrow(lambda it: _deal(bounds, it), "bucket int, ahead int, doc long, h long, text string")
    return dealt.repartitionById(len(bounds), "bucket").sortWithinPartitions("ahead", "doc", "h")


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "lcp_edited"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def one(doc, text, p, values, print_, after_text, after_print):
        q = p.n // 4
        tail = after_text[:q]
        e = PrefixHash(code_points(tail), p, p.n - q)
        since = max(0, p.n - q - WINDOW + 1)  # earlier windows lie in the part that stays
        new = np.concatenate([values[:since], mix(e.windows(WINDOW, since))]) if p.n >= WINDOW and e.n >= WINDOW else mix(e.windows(WINDOW))
        edited = render(e, smallest(new))
        sha = hashlib.sha256((text[:p.n - q] + tail).encode("utf-8")).hexdigest()
        return doc, p.n, sha, print_, edited, likeness(print_, edited), likeness(print_, after_print), p.extension(0, e, 0)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    held, out = None, []
    for b in C.sliced(batches):
        for ahead, doc, text in zip(b.column("ahead").to_pylist(), b.column("doc").to_pylist(), b.column("text").to_pylist()):
            if ahead and held is None:
                continue
            p = PrefixHash(code_points(text))
            values = mix(p.windows(WINDOW))
            print_ = render(p, smallest(values))
            if held is not None:
                out.append(one(*held, text, print_))
            held = None if ahead else (doc, text, p, values, print_)
            if len(out) >= 256:
                yield emit(out)
                out = []
    if out:
        yield emit(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (null ids: the largest long), n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next and lcp_edited (the longest
    common prefix of text and edited text) per row."""
    schema = ("doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, lcp_edited long")
    dealt = ranges(docs, id_col, text_col)
    if dealt is None:
        return docs.sparkSession.createDataFrame([], schema)
    return dealt.mapInArrow(_fingerprint_rows, schema)


def query(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(C.table(spark, sf_dir, "documents"))
    return out.select(F.when(F.col("doc") != C.LAST_ID, F.col("doc")).alias("doc_id"), *[c for c in out.columns if c != "doc"])
