"""A hot prompt with more rows than one chunk (default 65,536): the
skew-safe group operators equal their whole-group references."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rolloutlens.operators import groups as G
from rolloutlens.operators import ordered as OR
from rolloutlens.plans.scoring import score

HOT = OR.CHUNK + 4_500


@pytest.fixture(scope="module")
def hot(spark):
    # prompt 0: HOT generations in long runs of equal answers (the longest run
    # crosses the chunk border); prompts 1..40: ordinary groups of 8
    base = spark.range(HOT).select(F.lit(0).cast("long").alias("prompt_idx"), F.col("id").cast("int").alias("gen_idx"))
    small = spark.range(40 * 8).select((F.col("id") / 8 + 1).cast("long").alias("prompt_idx"),
                                       (F.col("id") % 8).cast("int").alias("gen_idx"))
    g = F.col("gen_idx")
    ans = (F.when((g >= OR.CHUNK - 2000) & (g < OR.CHUNK + 3000), F.lit(7))
            .otherwise(F.floor(g / 1000) % 3 + F.when(F.col("prompt_idx") > 0, g % 2).otherwise(0)))
    df = base.unionByName(small).select(
        "prompt_idx", "gen_idx", F.lit("\\boxed{7}").alias("gold"),
        F.concat(F.lit("\\boxed{"), ans.cast("string"), F.lit("}")).alias("content"))
    return score(df).cache()


def test_advantages_with_hot_key(hot):
    got = G.with_advantages(hot).select("prompt_idx", "gen_idx", "advantage")
    w = Window.partitionBy("prompt_idx")
    want = hot.select("prompt_idx", "gen_idx",
                      ((F.col("reward") - F.avg("reward").over(w)) / (F.stddev_pop("reward").over(w) + 1e-4)).alias("want"))
    bad = got.join(want, ["prompt_idx", "gen_idx"]).filter(F.abs(F.col("advantage") - F.col("want")) > 1e-9)
    assert got.count() == hot.count() and bad.count() == 0


def test_majority_with_hot_key(hot):
    got = {r.prompt_idx: r.majority for r in G.majority_run(hot).collect()}
    # whole-group reference on one prompt at a time
    rows = hot.select("prompt_idx", "gen_idx", F.col("ans.canon").alias("a"), "acc").collect()
    by = {}
    for r in rows:
        by.setdefault(r.prompt_idx, []).append((r.gen_idx, r.a, r.acc))
    for k, items in by.items():
        items.sort()
        best, best_n, i = 0.0, 0, 0
        while i < len(items):
            if items[i][1] is None:
                i += 1
                continue
            j = i
            while j + 1 < len(items) and items[j + 1][1] == items[i][1] and items[j + 1][0] == items[j][0] + 1:
                j += 1
            if j - i + 1 > best_n:
                best, best_n = items[i][2], j - i + 1
            i = j + 1
        assert got[k] == best, k
    assert got[0] == 1.0  # the run of 7s (5,000 long) straddles the chunk border and wins


def _sparse_hot(spark, n=6000):
    """One key with two thirds of the rows, at hash-like positions."""
    key = F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 50 + 1).cast("long")
    return spark.range(n).select(key.alias("k"), F.abs(F.xxhash64("id")).alias("pos"), (F.col("id") % 97).cast("double").alias("v"),
                                 (F.col("id") % 4 != 0).cast("int").alias("m"))


def _same(got, want, cols):
    a, b = ({(r["k"], r["pos"]): [None if r[c] is None else round(r[c], 6) for c in cols] for r in d.collect()} for d in (got, want))
    assert a == b and a


def test_normalisers_with_hot_key(spark):
    from rolloutlens.operators import normalize as N
    df = _sparse_hot(spark)
    w, kept = Window.partitionBy("k"), F.col("m") != 0
    mv = F.when(kept, F.col("v"))
    _same(N.zscore(df, "k", "v"), df.withColumn("z", (F.col("v") - F.avg("v").over(w)) / (F.stddev_samp("v").over(w) + 1e-4)), ["z"])
    _same(N.masked_zscore(df, "k", "v", "m"),
          df.withColumn("z", F.when(kept, (F.col("v") - F.avg(mv).over(w)) / (F.stddev_samp(mv).over(w) + 1e-4)).otherwise(0.0)), ["z"])
    _same(N.masked_min_max(df, "k", "v", "m"),
          df.withColumn("scaled", F.when(kept, (F.col("v") - F.min(mv).over(w)) / (F.max(mv).over(w) - F.min(mv).over(w))).otherwise(0.0)), ["scaled"])


def test_cumulative_sums_with_hot_key(spark):
    from rolloutlens.operators import normalize as N
    df = _sparse_hot(spark, 3000)
    w = Window.partitionBy("k").orderBy("pos")
    _same(N.cumulative_sum(df, "k", "pos", "v"), df.withColumn("cumsum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))), ["cumsum"])
    _same(N.cumulative_sum(df, "k", "pos", "v", reverse=True),
          df.withColumn("cumsum", F.sum("v").over(w.rowsBetween(0, Window.unboundedFollowing))), ["cumsum"])


def test_sparse_positions_share_ranges(spark):
    from rolloutlens.operators import normalize as N
    df = _sparse_hot(spark, 4000)
    w = Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    _same(N.cumulative_sum(df, "k", "pos", "v", chunk=150, dense=False), df.withColumn("cumsum", F.sum("v").over(w)), ["cumsum"])
    chunks = df.where("k = 0").select(OR.range_chunk(df, "pos", 150).alias("c")).groupBy("c").count().collect()
    assert 20 <= len(chunks) <= 27 and max(r["count"] for r in chunks) < 400  # not one chunk per row


@pytest.mark.parametrize("hot_rows", [10, 500, 10**6])
def test_normalisers_do_not_depend_on_what_is_hot(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(OR, "HOT_ROWS", hot_rows)
    test_normalisers_with_hot_key(spark)
    test_cumulative_sums_with_hot_key(spark)


def test_rows_of_a_hot_key_stay_where_they_are(spark):
    """Equal rows, too: they are not shuffled."""
    df = spark.range(0, 6000, 1, 8).select(F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 50 + 1).cast("long").alias("k"), F.lit(1.0).alias("v"))
    d = OR.attach_measured(df, "k", [F.avg("v").alias("a"), F.sum("v").alias("s")], hot_rows=500)
    per_task = d.where("k = 0").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert [r["n"] for r in per_task] == [500] * 8
    assert d.count() == 6000 and {(r["k"], r["s"]) for r in d.where("k in (0, 1)").distinct().collect()} == {(0, 4000.0), (1, 40.0)}
    plan = OR.attach_measured(df, "k", [F.avg("v").alias("a")])._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan  # no key is hot: one join


def test_few_keys_can_be_hot():
    for total in (0, 10**6, 10**12, 10**15):
        assert total / OR.hot_limit(total) <= OR.MOST_HOT and OR.hot_limit(total) >= OR.HOT_ROWS


def test_budget_fill_with_hot_prompt(spark):
    from rolloutlens.config import RunConfig
    from rolloutlens.operators import batching as B
    n = OR.CHUNK + 700
    hot = spark.range(n).select(F.lit(25).cast("long").alias("prompt_idx"), F.col("id").cast("int").alias("gen_idx"))
    rest = spark.range(800).select(F.expr("id div 8").alias("prompt_idx"), (F.col("id") % 8).cast("int").alias("gen_idx")).where("prompt_idx <> 25")
    kept = hot.unionByName(rest)
    cfg = RunConfig(group_size=8, max_num_seq=192, int_num=n + 100, rep_num=2, start_idx=10)
    got = sorted((r.position, r.prompt_idx, r.gen_idx) for r in B.fill_budget(kept, cfg).collect())
    rows = sorted((r.prompt_idx, r.gen_idx) for r in kept.where("prompt_idx >= 10").collect())[:n + 100]
    assert got == [(k + 1, *r) for k, r in enumerate(rows)]
