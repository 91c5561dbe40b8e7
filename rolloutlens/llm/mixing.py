"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target of words. A document's expected number of copies
is its source's target over its source's size; the whole part is given to
all, and the fractions are rounded so that a source's words hardly change.

Targets: the sources in code point order (null last) weigh ``weights``,
repeating, and share ``share`` times all words; none gets more than ``limit``
times its own words, and what is above goes to the others by weight until
none is above. That is one level t with target = min(limit * size, t * weight),
found by rounds of one small aggregate each (Newton steps on a concave
function, so they rise to t and end).

Rounding: of two documents with a fraction, words move at random from one to
the other until one of them has no fraction (all or nothing); the odds keep
each document's expectation, and the words of both together stay the same. The
other document takes its remaining fraction to the next pairing. So a source
ends up off its target by a part of one document only, the last one left.
Documents of like size (a class per quarter of a power of two) meet first, in
groups by a hash of the id of about ``FAN``; each group's residual goes up to
a group of groups, and so on (a reduction tree of fan-in ``FAN``, every level
written). A class keeps ``KEPT`` of its last items unpaired for the root, where
the classes of a source meet, the long documents first: what is left over of a
long document is used up by the many shorter ones that follow, so the last one
left is most often a very short document.

All of it is DataFrame and SQL functions; a group is folded by ``aggregate``.
A hot source spreads over as many groups as its documents fill. Equal rows
(source, id, size) are one item with a count: rounding k equal fractions leaves
one residual whatever the order, so a row repeated any number of times is one
row in the tree.

Defined results: null and empty texts have size 0 and nothing is taken. Null
ids are ids, the null source is a source. Equal rows get a row each. The random
numbers are hashes of id, size, source and tree level, so reruns agree on any
partitioning. A source of 0 words has the target 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a group of the tree, and groups of a group above.
FAN = 64
#: Documents of a source's class that meet the other classes at the root.
KEPT = 32
#: Equal rows that are written out by one array.
SPREAD = 1 << 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """source, id, size and how many rows have them (rows), written: the texts are read once."""
    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), word_count(F.col(text_col)).alias("size"))
    return C.written(rows.groupBy("source", "id", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-rows")


def weighted_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, weight by the source's place in code point order,
    null last. Ranges of sources are numbered apart; a row per range is summed."""
    n = C.shuffle_partitions(rows.sparkSession)
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")).withColumn("last", F.col("source").isNull())
    sizes = C.written(sizes.repartitionByRange(n, "last", "source").withColumn("range", F.spark_partition_id()), "mix-sources")
    counts = sizes.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row per partition at most
    before = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("last", "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    return sizes.join(F.broadcast(before), "range").select("source", "source_size", weight.alias("weight"))


def fill_level(sources: DataFrame, share: float = SHARE, limit: int = LIMIT) -> float:
    """The level t at which the sum of min(limit * size, t * weight) is share times all sizes."""
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("source_size") * limit <= F.col("weight") * level
        fixed, weight = sources.agg(F.sum(F.when(full, F.col("source_size") * limit)), F.sum(F.when(~full, F.col("weight")))).first()
        raised = (goal - (fixed or 0)) / weight if weight else level
        if raised <= level:
            return level
        level = raised


def source_targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """source, source_size, target; written."""
    sources = C.written(weighted_sources(rows, weights), "mix-weights")
    target = F.least(F.col("source_size") * float(limit), F.col("weight") * fill_level(sources, share, limit))
    return C.written(sources.select("source", "source_size", target.alias("target")), "mix-targets")


def _pair(state: Column, x: Column) -> Column:
    """One pairing: the group's residual so far and the next document."""
    r, done = state["left"], state["done"]
    room_r, room_x = r["size"] - r["mass"], x["size"] - x["mass"]
    up, down = F.least(room_r, x["mass"]), F.least(r["mass"], room_x)  # words that can move to r, to x
    to_r = x["u"] * (up + down) < down
    r_all, x_none = to_r & (room_r <= x["mass"]), to_r & (x["mass"] <= room_r)
    x_all, r_none = ~to_r & (room_x <= r["mass"]), ~to_r & (r["mass"] <= room_x)
    settled = F.concat(done, F.when(r_all | r_none, F.array(r.withField("full", r_all))).otherwise(F.array()),
                       F.when(x_all | x_none, F.array(x.withField("full", x_all))).otherwise(F.array()))
    left = F.when(~(r_all | r_none), r.withField("mass", F.when(to_r, r["mass"] + up).otherwise(r["mass"] - down))) \
        .when(~(x_all | x_none), x.withField("mass", F.when(to_r, x["mass"] - up).otherwise(x["mass"] + down)))
    return F.when(r.isNull(), F.struct(x.alias("left"), done.alias("done"))).otherwise(F.struct(left.alias("left"), settled.alias("done")))


ITEM = ("size", "u", "id", "mass", "rows", "whole", "full")


def _reduced(items: DataFrame, keys: list[str], level: int, kept: int = 0) -> DataFrame:
    """A group's items, long ones first, folded but for the last ``kept``:
    keys, left (what goes up: the residual and those kept), done."""
    item = F.struct("size", C.unit_hash("source", "id", "size", salt=f"mix-{level}").alias("u"), *ITEM[2:])
    kind = items.select(item.alias("item")).schema["item"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))
    n = F.greatest(F.size("items") - kept, F.lit(0))
    folded = F.aggregate(F.slice("items", F.lit(1), n), start, _pair)
    d = items.groupBy(*keys).agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    d = d.select(*keys, folded.alias("f"), F.slice("items", n + 1, F.lit(max(kept, 1))).alias("rest"))
    residual = F.when(F.col("f.left").isNotNull(), F.array("f.left")).otherwise(F.array())
    return d.select(*keys, F.concat(residual, "rest").alias("left"), F.col("f.done").alias("done"))


def rounded(items: DataFrame, fan: int = FAN) -> DataFrame:
    """items: source, its constants, id, size, rows, whole, mass in (0, size).
    The same without mass, with full: whether the document's fraction became
    a copy."""
    carried = ["source", "source_size", "target", "base"]
    out = [*carried, "id", "size", "rows", "whole", "full"]
    groups = max(1, -(-items.count() // fan))
    left = items.withColumn("full", F.lit(False)).withColumn("class", F.floor(F.log2("size") * 4).cast("int")) \
        .withColumn("bucket", F.pmod(F.xxhash64(F.lit("mix"), "id", "size"), F.lit(groups)))
    level, parts, keys = 0, [], [*carried, "class", "bucket"]
    while True:
        at_root = keys == carried
        done = C.written(_reduced(left, keys, level, kept=KEPT if groups == 1 and not at_root else 0), f"mix-level{level}")
        parts.append(done.select(*carried, F.explode("done").alias("x")).select(*carried, "x.*").select(*out))
        left = done.select(*keys, F.explode("left").alias("x")).select(*keys, "x.*").drop("u")
        level += 1
        if at_root:
            break
        if groups > 1:
            left, groups = left.withColumn("bucket", F.expr(f"bucket div {fan}")), -(-groups // fan)
        else:  # the classes of a source meet
            keys = carried
    last = left.withColumn("full", C.unit_hash("source", "id", "size", salt="mix-last") * F.col("size") < F.col("mass"))
    d = last.select(*out)
    for p in parts:
        d = d.unionByName(p)
    return d


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, fan: int = FAN) -> DataFrame:
    """Per row: id, source, size, source_size, target, copies."""
    rows = sized_rows(docs, id_col, text_col, source_col)
    targets = source_targets(rows, weights, share, limit).withColumnRenamed("source", "_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = rows.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("base", F.floor(rate)) \
        .withColumn("sum", (rate - F.col("base")) * F.col("rows"))  # of the fractions of equal rows
    d = d.withColumn("whole", F.when(F.col("size") > 0, F.floor("sum")).otherwise(F.lit(0))) \
        .withColumn("mass", F.when(F.col("size") > 0, (F.col("sum") - F.col("whole")) * F.col("size")).otherwise(F.lit(0.0))) \
        .select("source", "source_size", "target", "base", "id", "size", "rows", "whole", "mass")
    d = C.written(d, "mix-items")
    settled = d.where("mass <= 0").withColumn("full", F.lit(False)).drop("mass")
    d = settled.unionByName(rounded(d.where("mass > 0"), fan))
    # a row for each of the equal rows; the first ones take the copies
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {SPREAD}"))))
    if rows.where(F.col("rows") > SPREAD).limit(1).count():
        d = d.repartition("id", "block")
    first, last = F.col("block") * SPREAD, F.least(F.col("rows"), (F.col("block") + 1) * SPREAD) - 1
    d = d.withColumn("place", F.explode(F.sequence(first, last)))
    copies = F.col("base") + ((F.col("place") < F.col("whole")) | ((F.col("place") == F.col("whole")) & F.col("full"))).cast("long")
    return d.select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(C.table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
