"""Answer extraction / equivalence (A1, A2) on hand-made edge rows."""
from pyspark.sql import functions as F

from rolloutlens.functions import answers as A

CASES = [  # (content, gold, expected equal)
    (r"so \boxed{\frac{1}{2}}", r"\boxed{0.5}", True),
    (r"\boxed{a_{b_{c_{d}}}}", r"\boxed{a_{b_{c_{d}}}}", True),
    (r"\boxed{42", r"\boxed{42}", False),
    (r"\boxed{1} then \boxed{2}", r"\boxed{2}", True),
    (r"\boxed{0.5}", r"\boxed{1/2}", True),
    (r"\boxed{1,000}", r"\boxed{1000}", True),
    (r"\boxed{1,23}", r"\boxed{123}", False),
    (r"\boxed{3/0}", r"\boxed{3/0}", True),
    (r"\boxed{\dfrac{3}{4}}", r"\boxed{0.75}", True),
    (r"\boxed{x=5}", r"\boxed{5}", True),
    (r"\boxed{5\%}", r"\boxed{5}", True),
    (r"\boxed{90^\circ}", r"\boxed{90}", True),
    (r"\boxed{10\text{ cm}}", r"\boxed{10}", True),
    (r"\boxed{-2.50}", r"\boxed{-5/2}", True),
    (r"no box", r"\boxed{1}", False),
    (r"\boxed{}", r"\boxed{1}", False),
    (r"\boxed{x+1}", r"\boxed{1+x}", False),
    (r"\boxed{7}", r"the answer is $7$", True),
    # any brace depth, nested and unclosed boxes
    (r"\boxed{1{2{3{4{5{6{7{8}}}}}}}}", r"\boxed{1{2{3{4{5{6{7{8}}}}}}}}", True),
    (r"\boxed{1{2{3{4{5{6{7{8}}}}}}}}", r"\boxed{1{2{3{4{5{6{7{9}}}}}}}}", False),
    (r"\boxed{a \boxed{b}}", r"\boxed{b}", False),
    (r"\boxed{open \boxed{5}", r"\boxed{5}", True),
    (r"} stray { \boxed{5}", r"\boxed{5}", True),
    # text answers and units
    (r"\boxed{\text{yes}}", r"\boxed{yes}", True),
    (r"\boxed{\text{yes}}", r"\boxed{\text{no}}", False),
    (r"\boxed{wrong}", r"\boxed{\text{yes}}", False),
    # signs
    (r"\boxed{\frac{-1}{2}}", r"\boxed{-\frac{1}{2}}", True),
    (r"\boxed{\frac{-1}{2}}", r"\boxed{-0.5}", True),
    (r"\boxed{\frac{-1}{-2}}", r"\boxed{0.5}", True),
    (r"\boxed{3/-4}", r"\boxed{-0.75}", True),
    (r"\boxed{+5}", r"\boxed{5}", True),
    (r"\boxed{.5}", r"\boxed{0.5}", True),
    (r"\boxed{-.5}", r"\boxed{1/2}", False),
    (r"\boxed{-0}", r"\boxed{0}", True),
    # decimals of any length
    (r"\boxed{1234567890}", r"\boxed{1234567890.0}", True),
    (r"\boxed{0.12345670}", r"\boxed{0.1234567}", True),
    (r"\boxed{00012345678901234567890.5000}", r"\boxed{12345678901234567890.5}", True),
    (r"\boxed{12345678901234567890}", r"\boxed{12345678901234567891}", False),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c, g) for i, (c, g, _) in enumerate(CASES)], "id int, c string, g string")
    df = A.with_parsed(A.with_parsed(df, "c", "a"), "g", "b", gold=True)
    got = [r[0] for r in df.orderBy("id").select(A.answers_equal(F.col("a"), F.col("b"))).collect()]
    assert got == [e for _, _, e in CASES]


def test_unparseable_is_null(spark):
    df = spark.createDataFrame([("nothing",), (r"\boxed{ }",)], "c string")
    df = A.with_parsed(df, "c", "a")
    assert [r[0] for r in df.select("a.canon").collect()] == [None, None]


def test_gold_with_a_box_is_parseable(spark):
    golds = [r"\boxed{\text{yes}}", r"\boxed{1{2{3{4{5{6}}}}}}", r"\boxed{\frac{-1}{2}}", r"\boxed{.5}", r"\boxed{123456789012345678901234567890}"]
    df = A.with_parsed(spark.createDataFrame([(g,) for g in golds], "g string"), "g", "b", gold=True)
    assert all(r[0] is not None for r in df.select("b.canon").collect())


def test_long_text_with_many_braces(spark):
    text = "{x} " * 20000 + r"\boxed{4{2}}" + " }" * 500
    df = A.with_parsed(spark.createDataFrame([(text,)], "c string"), "c", "a")
    assert df.select("a.canon").first()[0] == "4{2}"


def test_long_fractions_inside_values_come_to_lowest_terms(spark):
    from pyspark.sql import functions as F

    from rolloutlens.functions import answers as A
    a, b = 679891637638612258, 1100087778366101931  # neighbours in Fibonacci's row: Euclid's longest way
    pairs = [(a, b, 2 * a, 2 * b), (b, a, 2 * b, 2 * a), (6, 4, 3, 2), (0, 7, 0, 1), (5, 1, 5, 1)]
    text = lambda n, d: r"\boxed{(\frac{%d}{%d},1)}" % (n, d)
    df = spark.createDataFrame([(text(n, d), text(m, e)) for n, d, m, e in pairs], "x string, y string")
    got = A.with_parsed(A.with_parsed(df, "x", "a"), "y", "b").select(F.col("a.canon"), F.col("b.canon")).collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert got[0][0] == f"({a}/{b},1)" and got[2][0] == "(3/2,1)"


def test_nested_answers_are_spread_over_the_cores(spark):
    from rolloutlens.sources import fixtures as FX
    assert FX.nested_answers(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
