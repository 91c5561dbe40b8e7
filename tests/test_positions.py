"""Permutations computed inside the row, places of unkeyed rows, pairing by place."""
import duckdb
import pytest
from pyspark.sql import functions as F

from rolloutlens.functions import permute as PM
from rolloutlens.operators import batching as B
from rolloutlens.operators import prompts as P
from rolloutlens.sources import readers as RD

from .conftest import SF_SMALL


def plain(place, n, seed):
    """The network with Python's numbers."""
    a, b = PM.grid(n)
    while True:
        half = [place // b, place % b]
        for r, (factor, addend) in enumerate(PM.keys(seed)):
            t = (half[1 - r % 2] * factor + addend) % PM.PRIME
            half[r % 2] = (half[r % 2] + (t * t % PM.PRIME) // 8) % (a, b)[r % 2]
        place = half[0] * b + half[1]
        if place < n:
            return place


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 63, 64, 65, 1000, 9973])
@pytest.mark.parametrize("seed", [0, 42])
def test_permutation(spark, n, seed):
    d = spark.range(n).withColumnRenamed("id", "_left")  # a column with a name used inside
    got = {r["p"]: r["q"] for r in B.permuted_shuffle(d.select(F.col("_left").alias("p")), "p", n, seed, "q").collect()}
    assert got == {p: plain(p, n, seed) for p in range(n)} and sorted(got.values()) == list(range(n))
    con = duckdb.connect()
    con.execute(f"CREATE TABLE x AS SELECT range AS p FROM range({n})")
    assert dict(con.execute(f"SELECT p, q FROM ({PM.permuted_sql('x', 'p', '(SELECT count(*) FROM x)', seed, 'q')})").fetchall()) == got


def test_permutation_of_many_places_mixes(spark):
    n = 200_000
    d = B.permuted_shuffle(spark.range(n).withColumnRenamed("id", "p"), "p", n, 7, "q")
    r = d.agg(F.countDistinct("q").alias("n"), F.max("q").alias("top"), F.corr("p", "q").alias("c"), F.sum((F.col("p") == F.col("q")).cast("int")).alias("fixed")).first()
    assert (r["n"], r["top"]) == (n, n - 1) and abs(r["c"]) < 0.01 and r["fixed"] < 10
    steps = d.alias("a").join(d.select((F.col("p") - 1).alias("p"), F.col("q").alias("next")), "p")
    assert steps.select(F.pmod(F.col("next") - F.col("q"), F.lit(n)).alias("s")).distinct().count() > 0.6 * n
    with pytest.raises(ValueError):
        PM.with_permuted(d, "p", 1 << 52, 1, "x")


def test_places_beyond_2_to_the_40(spark):
    n, seed = (1 << 45) + 12345, 3
    places = [0, 1, n // 2, n - 2, n - 1]
    d = spark.createDataFrame([(p,) for p in places], "p long")
    assert [r["q"] for r in PM.with_permuted(d, "p", n, seed, "q").orderBy("p").collect()] == [plain(p, n, seed) for p in places]


def test_shuffle_moves_no_row(spark):
    d = RD.read_positioned(spark, f"{SF_SMALL}/documents.parquet")
    plan = B.permuted_shuffle(d, "row_pos", 200, 42)._jdf.queryExecution().executedPlan().toString()
    rows = plan.split("BroadcastExchange")[0]  # what comes after is the count of the files
    assert "FileScan parquet" in plan and "Exchange" not in rows and "Sort" not in rows.replace("SortedSet", "")


def listed(spark, path, values, files):
    """Files of different sizes that hold the values in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    cuts = sorted({0, len(rows), *(len(rows) * k * k // (files * files) for k in range(files))})
    for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
        spark.createDataFrame(rows[a:z], "i int, v string").coalesce(1).select("v").write.mode("append").parquet(f"{path}/part={k:03d}")
    return path


@pytest.mark.parametrize("n,files", [(0, 1), (1, 1), (500, 1), (500, 6)])
def test_places_follow_files_and_rows(spark, tmp_path, n, files):
    values = [f"v{i}" for i in range(n)]
    if not n:
        spark.createDataFrame([], "v string").write.parquet(str(tmp_path / "t"))
    else:
        listed(spark, str(tmp_path / "t"), values, files)
    d = RD.read_positioned(spark, str(tmp_path / "t"))
    assert [r["v"] for r in d.orderBy("row_pos").collect()] == values
    assert sorted(r["row_pos"] for r in d.collect()) == list(range(n))


def test_places_do_not_depend_on_splits(spark, tmp_path):
    values = [f"{i} " + "x" * 50 for i in range(5000)]
    spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).write.option("parquet.block.size", 4096) \
        .option("parquet.page.size", 512).parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1kb", "16kb", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {r["v"]: r["row_pos"] for r in RD.read_positioned(spark, str(tmp_path / "t")).collect()}
            assert got == {v: i for i, v in enumerate(values)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_pairs_by_place(spark, tmp_path):
    left = listed(spark, str(tmp_path / "a"), [f"a{i}" for i in range(300)], 5)
    right = listed(spark, str(tmp_path / "b"), [f"b{i}" for i in range(230)], 3)  # shorter: its last pair is 229
    a = RD.read_positioned(spark, left).select("row_pos", F.col("v").alias("x"))
    b = RD.read_positioned(spark, right).select("row_pos", F.col("v").alias("y"))
    assert sorted((r["row_pos"], r["x"], r["y"]) for r in P.pair_by_position(a, b).collect()) == [(i, f"a{i}", f"b{i}") for i in range(230)]
    with pytest.raises(ValueError):
        P.pair_by_position(RD.read_positioned(spark, left), RD.read_positioned(spark, right))


def test_paths_are_concatenated_in_the_order_given(spark, tmp_path):
    a = listed(spark, str(tmp_path / "z"), ["1", "2", "3"], 2)
    b = listed(spark, str(tmp_path / "y"), ["4", "5"], 1)
    assert [r["v"] for r in RD.read_positioned(spark, a, b).orderBy("row_pos").collect()] == list("12345")
    assert [r["v"] for r in RD.read_positioned(spark, b, a).orderBy("row_pos").collect()] == list("45123")
