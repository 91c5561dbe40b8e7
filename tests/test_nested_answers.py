"""A1 / A2: tuples, sets, lists and intervals of any depth."""
import pytest
from pyspark.sql import functions as F

from rolloutlens.functions import answers as A

EQUAL = [
    ("(1, 2)", "(1.0,2)"), ("(1/2, 3)", r"(\frac{1}{2},3.00)"), (r"\{1, 2, 3\}", r"\{3,1,2\}"), (r"\{1,1,2\}", r"\{2, 1, 1\}"),
    (r"\left(0, \frac{1}{2}\right]", "(0,0.5]"), ("[1,2]", "[+1.0, 2.]"), (r"\{(1,2),(3,4)\}", r"\{(3,4.0),(1,2)\}"),
    (r"\{\{1,2\},\{3\}\}", r"\{\{3\},\{2,1\}\}"), ("(x,y)", "(x, y)"), ("1,23", "1.0, 23"), ("(-1,-2)", r"(-\frac{2}{2},-2)"), ("()", "()"),
    ("((((1))))", "((((1.0))))"), (r"\{\frac{2}{4},x\}", r"\{x,0.5\}"), (r"(\sqrt{2},1)", r"(\sqrt{2},1.0)"), ("(1,2,)", "(1,2, )"),
    (r"\{(1,\{3,2\}),0\}", r"\{0,(1.0,\{2,3\})\}"), ("(2/4,6/4)", "(1/2,1.5)"), (r"\{10,9,2\}", r"\{2,9,10\}"), ("(1,2)", r"\left( 1 ,\, 2 \right)"),
    ("(0.100000000000000001,2)", r"(\frac{100000000000000001}{1000000000000000000},2)")]
DIFFERENT = [
    ("(1,2)", "(2,1)"), (r"\{1,2\}", r"\{1,2,2\}"), ("(1,2)", "[1,2]"), ("(0,1]", "[0,1)"), (r"\{1,2\}", "(1,2)"), ("(1,2)", "(1,2,3)"), ("((1,2),3)", "(1,2,3)"),
    (r"\{(1,2)\}", r"\{(2,1)\}"), ("(1,2)", "12"), ("(1)", "1"), (r"\{1\}", "1"), ("f(1,2)", "(1,2)"), ("1,2", "2,1"), ("(1/2,3)", "(1/3,3)"),
    (r"\{\{1,2\},3\}", r"\{1,2,3\}"), ("(1,2", "(1,2)"), ("1,2)", "(1,2)"), ("(1,,2)", "(1,2)")]


def equal(spark, pairs):
    df = spark.createDataFrame([(i, rf"\boxed{{{a}}}", rf"\boxed{{{b}}}") for i, (a, b) in enumerate(pairs)], "i int, x string, y string")
    d = A.with_parsed(A.with_parsed(df, "x", "a"), "y", "b")
    return {pairs[r[0]]: r[1] for r in d.select("i", A.answers_equal(F.col("a"), F.col("b"))).collect()}


@pytest.mark.parametrize("swap", [False, True])
def test_case_table(spark, swap):
    pairs = EQUAL + DIFFERENT
    got = equal(spark, [p[::-1] for p in pairs] if swap else pairs)
    wrong = [p for p in pairs if got[p[::-1] if swap else p] != (p in EQUAL)]
    assert not wrong, wrong


def test_any_depth_and_many_parts(spark):
    deep = "(" * 150 + "1" + ")" * 150
    many = ",".join(f"{k}/2" for k in range(300))
    halves = ",".join(str(k / 2) for k in reversed(range(300)))
    got = equal(spark, [(deep, deep.replace("1", "1.0")), (deep, deep[1:-1]), (rf"\{{{many}\}}", rf"\{{{halves}\}}"), (f"({many})", f"({halves})")])
    assert list(got.values()) == [True, False, True, False]
