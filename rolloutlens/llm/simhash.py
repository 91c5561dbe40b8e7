"""SimHash near-duplicates through the generalised pigeonhole principle.

Fingerprint: word shingles (ASCII white space, A-Z lower-cased, repeats
included) are hashed with XXH64, seed 42; a bit is 1 if set in over half of
the hashes. Two fingerprints link at ``max_bits`` or fewer differing bits.

Search, over distinct fingerprints only (copies collapse first):
 1. a 64 x 64 table of bit sums over all fingerprints gives the bits'
    correlation; correlated bits are grouped into one of m parts, which
    leaves the other parts selective;
 2. if thresholds T_1..T_m of a fingerprint sum to max_bits - m + 1, any
    fingerprint within max_bits agrees with it up to T_i bits in some part i
    (T_i = -1: part i is not looked at). Dynamic programming picks, for every
    fingerprint, the T with the fewest estimated candidates, from counts of
    frequent part values and a bit model for the others;
 3. every fingerprint is indexed under its m part values and probes the
    values within T_i of its own. A value with many index entries is dealt
    over several salts and its probes are sent to each;
 4. the task that holds a value checks distances in blocks and emits, per
    probe, one link to each set of entries it joins, so a dense group gives
    about as many links as it has members and probes, not all its pairs;
 5. alternating large-star and small-star steps join the links to components.

Defined results: null or empty text, or one without a word, has fingerprint
zero and links like any other. Fewer words than a shingle: the whole sequence
is one shingle. Null ids are one document after all others, repeated rows
share id and component. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE, MAX_BITS, SEED, BITS = 3, 2, 42, 64
#: Index entries of one part value that one task holds; beyond, the value is salted.
BUCKET = 4096
#: Part values counted as frequent: those of over 1 / FREQUENT of all fingerprints.
FREQUENT = 2000
SKIP = -1


# ---- fingerprints ---------------------------------------------------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a whole text (0 if it has no word)."""
    import xxhash
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII white space and A-Z only
    if not words:
        return 0
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    votes, n = np.zeros(BITS, np.int64), 0
    h = np.fromiter(map(digest, grams), np.uint64)
    for i in range(0, len(h), 8192):
        part = h[i:i + 8192]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(shingle: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.sliced(batches):
        fp = np.array([fingerprint(t, shingle) for t in C.texts(b, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(fp)], ["doc", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc (null ids: the largest long), fp (signed 64 bits) per row."""
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.LAST_ID)).alias("doc"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_fingerprint_batches, shingle), "doc long, fp long")


# ---- parts and thresholds -------------------------------------------------------------------------------------------

def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit sums and sums of bit products: 65 x 64 numbers per task."""
    total = np.zeros((BITS + 1, BITS))
    for b in batches:
        x = _bits(b.column("fp").to_numpy(zero_copy_only=False).copy()).astype(np.float32)
        total[0] += x.sum(0)
        total[1:] += (x.T @ x).astype(float)
    yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel().astype(np.int64))], ["cell", "v"])


def bit_moments(distinct: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = distinct.select("fp").mapInArrow(_moments, "cell int, v long").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((BITS + 1) * BITS)
    for r in rows:
        total[r["cell"]] = r["v"]
    total = total.reshape(BITS + 1, BITS)
    return total[0], total[1:]


def group_bits(n: int, sums: np.ndarray, products: np.ndarray, parts: int) -> list[list[int]]:
    """Bits into parts of nearly equal size: each part starts from the bit
    least tied to the parts so far and takes the bits most tied to it."""
    p = sums / max(n, 1)
    cov = products / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = (len(free) + parts - k - 1) // (parts - k)
        seed = max(free, key=lambda i: (round(float(tie[i, free].sum()), 6), -i))
        group = [seed]
        free.remove(seed)
        while len(group) < size:
            nxt = max(free, key=lambda i: (round(float(tie[i, group].sum()), 6), -i))
            group.append(nxt)
            free.remove(nxt)
        groups.append(sorted(group))
    return groups


def part_value(fp: np.ndarray, group: list[int]) -> np.ndarray:
    """The part's bits, packed into an integer."""
    x, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for j, bit in enumerate(group):
        out |= ((x >> np.uint64(bit)) & np.uint64(1)) << np.uint64(j)
    return out.view(np.int64)


def masks(width: int, radius: int) -> np.ndarray:
    """All masks of at most ``radius`` of ``width`` bits."""
    from itertools import combinations
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def estimates(fp: np.ndarray, groups: list[list[int]], n: int, p: np.ndarray, frequent: list[dict[int, int]], max_bits: int) -> np.ndarray:
    """Estimated cost (probes and candidates) of threshold t in part i for
    every fingerprint: shape (parts, max_bits + 1, rows). A frequent value has
    its count; the rest follows from the bits' shares, distance by distance
    (the distribution of a sum of independent bits)."""
    out = np.zeros((len(groups), max_bits + 1, len(fp)))
    bits = _bits(fp)
    for i, group in enumerate(groups):
        q = np.clip(p[group], 1e-3, 1 - 1e-3)
        same = np.where(bits[:, group] == 1, q, 1 - q)
        prob = np.zeros((max_bits + 1, len(fp)))
        prob[0] = 1
        for j in range(len(group)):
            s = same[:, j]
            for d in range(max_bits, 0, -1):
                prob[d] = prob[d] * s + prob[d - 1] * (1 - s)
            prob[0] *= s
        expected = n * prob
        if frequent[i]:
            keys = np.array(sorted(frequent[i]), np.int64)
            sizes = np.array([frequent[i][k] for k in keys.tolist()], float)
            value = part_value(fp, group)
            for d in range(max_bits + 1):
                for mask in masks(len(group), d)[len(masks(len(group), d - 1)) if d else 0:] if d < 2 else []:
                    at = np.minimum(np.searchsorted(keys, value ^ mask), len(keys) - 1)
                    hit = keys[at] == value ^ mask
                    expected[d] += np.where(hit, sizes[at], 0)
        cost = expected.cumsum(0)
        for t in range(max_bits + 1):
            cost[t] += sum(math.comb(len(group), d) for d in range(t + 1))
        out[i] = cost
    return out


def allocate(cost: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds (rows, parts) of least total cost with sum max_bits - parts
    + 1, each from -1 (cost 0) to max_bits; by dynamic programming over parts."""
    parts, _, n = cost.shape
    spend = max_bits + 1  # each part spends T_i + 1 of max_bits + 1
    best = np.full((spend + 1, n), np.inf)
    best[0] = 0
    choice = np.zeros((parts, spend + 1, n), np.int8)
    for i in range(parts):
        new = np.full_like(best, np.inf)
        for used in range(spend + 1):
            for take in range(used + 1):
                c = best[used - take] + (cost[i, take - 1] if take else 0)
                better = c < new[used]
                new[used] = np.where(better, c, new[used])
                choice[i, used] = np.where(better, take, choice[i, used])
        best = new
    left, out = np.full(n, spend), np.zeros((n, parts), np.int8)
    for i in range(parts - 1, -1, -1):
        take = choice[i, left, np.arange(n)]
        out[:, i] = take - 1
        left = left - take
    return out


def choose_parts(n: int, max_bits: int) -> int:
    """The number of parts with the fewest expected probes and candidates if
    bits were even; at least two, and no more than leave one exact part."""
    def cost(m: int) -> float:
        width, spend = BITS // m, max_bits + 1
        take = [spend // m + (i < spend % m) for i in range(m)]
        return sum(math.comb(width, d) * (1 + n / 2.0**width) for t in take for d in range(t))
    return min(range(2, max(2, max_bits + 1) + 1), key=lambda m: (cost(m), m))


# ---- probe and verify -----------------------------------------------------------------------------------------------

def _keys(plan: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, value, salt, probe (0 index, 1 probe), fp."""
    groups, salts = plan["groups"], plan["salts"]

    def rows(part, value, salt, probe, fp):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), part, np.int32)), pa.array(value), pa.array(salt), pa.array(np.full(len(fp), probe, np.int32)),
                                           pa.array(fp)], ["part", "value", "salt", "probe", "fp"])

    for b in C.sliced(batches, 16_384):
        fp = b.column("fp").to_numpy(zero_copy_only=False).copy()
        if not len(fp):
            continue
        cost = estimates(fp, groups, plan["n"], plan["p"], plan["frequent"], plan["max_bits"])
        t = allocate(cost, plan["max_bits"])
        for i, group in enumerate(groups):
            value = part_value(fp, group)
            hot = salts[i]
            over = np.array([hot.get(v, 1) for v in value.tolist()], np.int64)
            mixed = (fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield rows(i, value, (mixed.astype(np.int64) % over).astype(np.int32), 0, fp)
            for radius in range(plan["max_bits"] + 1):
                who = t[:, i] == radius
                if not who.any():
                    continue
                m = masks(len(group), radius)
                v = (value[who][:, None] ^ m[None, :]).ravel()
                f = np.repeat(fp[who], len(m))
                s = np.array([hot.get(x, 1) for x in v.tolist()], np.int64) if hot else np.ones(len(v), np.int64)
                each = np.repeat(np.arange(len(v)), s)
                salt = np.arange(len(each)) - np.repeat(s.cumsum() - s, s)
                for a in range(0, len(each), 65_536):
                    e = each[a:a + 65_536]
                    yield rows(i, v[e], salt[a:a + 65_536].astype(np.int32), 1, f[e])


class _Block:
    """The index entries of one part value and salt, with the sets that the
    links found so far make of them."""

    def __init__(self):
        self.entries: list[np.ndarray] = []
        self.fp: np.ndarray | None = None

    def add(self, fp: np.ndarray) -> None:
        self.entries.append(fp.copy())

    def links(self, probes: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
        if self.fp is None:
            if not self.entries:
                return
            self.fp = np.unique(np.concatenate(self.entries))
            self.label = np.arange(len(self.fp))
        block, label = self.fp.view(np.uint64), self.label
        step = max(1, 1_000_000 // len(block))
        for a in range(0, len(probes), step):
            q = probes[a:a + step]
            near = np.bitwise_count(q.view(np.uint64)[:, None] ^ block[None, :]) <= max_bits
            for i in np.nonzero(near.any(1))[0].tolist():
                x, at = int(q[i]), np.nonzero(near[i])[0]
                sets, first = np.unique(label[at], return_index=True)
                own = np.searchsorted(self.fp, x)
                mine = label[own] if own < len(block) and self.fp[own] == x else -1
                for s, k in zip(sets.tolist(), at[first].tolist()):
                    if s != mine:  # one link to each set that the probe does not belong to yet
                        yield min(x, int(self.fp[k])), max(x, int(self.fp[k]))
                if len(sets) > 1:
                    label[np.isin(label, sets)] = sets[0]


def _verify(max_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted keys in, index entries of a value before its probes; links that
    keep every pair within max_bits connected out. Holds one block."""
    key, block = None, _Block()
    names = ("part", "value", "salt", "probe")
    for b in batches:
        if not b.num_rows:
            continue
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        same = np.zeros(b.num_rows, bool)
        same[1:] = np.logical_and.reduce([cols[n][1:] == cols[n][:-1] for n in names])
        starts = np.nonzero(~same)[0]
        found = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            k = (cols["part"][s], cols["value"][s], cols["salt"][s])
            if k != key:
                key, block = k, _Block()
            if cols["probe"][s] == 0:
                block.add(cols["fp"][s:e])
            else:
                found += block.links(cols["fp"][s:e], max_bits)
        a, z = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose transitive
    closure is that of all pairs within max_bits."""
    spark = distinct.sparkSession
    n = distinct.count()
    if max_bits <= 0 or n < 2:
        return spark.createDataFrame([], "a long, b long")
    m = choose_parts(n, max_bits)
    sums, products = bit_moments(distinct)
    groups = group_bits(n, sums, products, m)
    # frequent part values: at most FREQUENT per part, whatever n is
    packed = F.array(*[_packed(g) for g in groups])
    count = distinct.select(F.posexplode(packed).alias("part", "value")).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = count.where(F.col("n") > max(8, n // FREQUENT)).collect()
    frequent = [{r["value"]: r["n"] for r in rows if r["part"] == i} for i in range(m)]
    plan = {"groups": groups, "n": n, "p": sums / n, "frequent": frequent, "max_bits": max_bits,
            "salts": [{v: -(-c // BUCKET) for v, c in f.items() if c > BUCKET} for f in frequent]}
    keys = distinct.select("fp").mapInArrow(functools.partial(_keys, plan), "part int, value long, salt int, probe int, fp long")
    if n // FREQUENT > BUCKET:  # values too many to name on the driver can fill more than a bucket
        keys = _split(keys, count.where((F.col("n") > BUCKET) & (F.col("n") <= max(8, n // FREQUENT))))
    return (keys.repartition("part", "value", "salt").sortWithinPartitions("part", "value", "salt", "probe")
            .mapInArrow(functools.partial(_verify, max_bits), "a long, b long").distinct())


def _split(keys: DataFrame, large: DataFrame) -> DataFrame:
    """Keys of the values of ``large`` (part, value, n; a row per value, met by
    a join) over as many salts as they fill buckets: each index entry in
    one, each probe in all."""
    salts = large.select("part", "value", F.ceil(F.col("n") / BUCKET).cast("int").alias("salts"))
    mixed = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    own = F.when(F.col("salts").isNull(), F.array("salt")).when(F.col("probe") == 0, F.array(mixed)) \
        .otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    return keys.join(salts, ["part", "value"], "left").withColumn("salt", F.explode(own)).select("part", "value", "salt", "probe", "fp")


def _packed(group: list[int]):
    return functools.reduce(lambda x, y: x.bitwiseOR(y), [
        F.shiftleft(F.shiftrightunsigned(F.col("fp"), bit).bitwiseAND(F.lit(1).cast("long")), j) for j, bit in enumerate(group)])


# ---- components -----------------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """v, c: the smallest vertex reachable, for every vertex that has a link
    (and is not itself the smallest). Each round is written, so a lost
    executor costs at most a round."""
    e = C.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "simhash-edges")

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 31) - 1)))).first())

    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = C.written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "simhash-large")
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a")
        e = C.written(small.select("a", F.col("m").alias("b")).unionByName(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "simhash-small")
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("v"), F.col("b").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc (null ids: the largest long), fp, component per row."""
    fps = C.written(fingerprints(docs, id_col, text_col, shingle), "simhash-fingerprints")
    reps = C.written(fps.groupBy("fp").agg(F.min("doc").alias("rep")), "simhash-distinct")
    pairs = C.written(links(reps.select("fp"), max_bits), "simhash-links")
    # from fingerprints to their smallest documents: components then end at the smallest id
    ends = pairs.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a") \
        .join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    comp = components(ends)
    of_fp = C.written(reps.join(comp.withColumnRenamed("v", "rep"), "rep", "left")
                      .select("fp", F.coalesce("c", "rep").alias("component")), "simhash-components")
    # one row per fingerprint on the right; both sides are plain scans, so a fingerprint that a third of all rows share is split
    return fps.join(of_fp, "fp").select("doc", "fp", "component")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The input's rows and columns with one document of each component: that
    of the smallest id, and of several rows with that id the one whose text
    has the smallest hash, once. Only ids of documents that go are joined to
    the texts."""
    found = C.written(near_duplicates(docs, id_col, text_col, shingle, max_bits), "simhash-groups")
    gone = found.where("doc <> component").select(F.col("doc").alias("_sh_gone")).distinct()
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(C.LAST_ID))
    left = docs.withColumn("_sh_id", key).join(gone.hint("shuffle_hash"), F.col("_sh_id") == F.col("_sh_gone"), "left_anti")
    again = found.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc").alias("_sh_again"))
    if again.isEmpty():
        return left.drop("_sh_id")
    # ids with several rows: one row stays
    repeated = left.join(again, F.col("_sh_id") == F.col("_sh_again"), "left_semi").withColumn("_sh_text", F.xxhash64(text_col))
    one = repeated.groupBy("_sh_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col("_sh_text")).alias("_sh_row"))
    single = left.join(again, F.col("_sh_id") == F.col("_sh_again"), "left_anti").drop("_sh_id")
    return single.unionByName(one.select("_sh_row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(C.table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != C.LAST_ID, F.col(c))
    return out.select(real("doc").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), real("component").alias("component_id"))
