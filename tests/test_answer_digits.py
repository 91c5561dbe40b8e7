"""A2: long decimals and fractions have a rational reading."""
from rolloutlens.functions import answers as A

CASES = [
    ("1234567890", r"\frac{2469135780}{2}", True), ("1234567890", r"\frac{2469135781}{2}", False),
    ("0.12345678", "12345678/100000000", True), ("-12345678901.25", r"-\frac{49382715605}{4}", True),
    ("9999999999999999999", "9999999999999999999/1", True), ("9999999999999999999", "9999999999999999998/1", False),
    (r"\frac{9999999999999999999}{9999999999999999998}", r"\frac{9999999999999999998}{9999999999999999997}", False),
    ("0.5", "1/2", True), ("1/0", "2/0", False), ("0.000000000000000001", "1/1000000000000000000", True)]


def test_long_numbers_compare_exactly(spark):
    df = spark.createDataFrame([(i, rf"\boxed{{{a}}}", rf"\boxed{{{b}}}") for i, (a, b, _) in enumerate(CASES)], "i int, x string, y string")
    d = A.with_parsed(A.with_parsed(df, "x", "a"), "y", "b")
    from pyspark.sql import functions as F
    got = {r[0]: r[1] for r in d.select("i", A.answers_equal(F.col("a"), F.col("b"))).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for *_, want in CASES]


def test_wide_pairs_are_equal_as_numbers(spark):
    """The registered wide pairs against Python's fractions."""
    from fractions import Fraction

    from rolloutlens.plans.catalog import QUERIES

    from .conftest import SF_SMALL
    rows = {r["o_orderkey"]: round(r["o_totalprice"] * 100) * 10**11 + r["o_orderkey"] for r in spark.read.parquet(f"{SF_SMALL}/orders.parquet").collect()}
    got = {r["prompt_idx"]: r for r in QUERIES["a2_wide_numbers"](spark, SF_SMALL).collect()}
    value = lambda n, form: Fraction(n, 1000 if form >= 6 else 1)
    want = {k: int(value(n, k % 8) == value(n + (k % 7 == 0), k // 8 % 8)) for k, n in rows.items()}
    assert {k: r["equal"] for k, r in got.items()} == want and set(want.values()) == {0, 1}
    assert {r["numeric"] for r in got.values()} == {1} and max(len(r["ans_canon"]) for r in got.values()) >= 19
