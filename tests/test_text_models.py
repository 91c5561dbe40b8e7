"""Text rules against small plain-Python models written from the rules."""
import re

import pytest
from pyspark.sql import functions as F

from rolloutlens.functions import text as TX

EDGE = ["", "a", "answer is 1000", "wait...", "\n\n\n\n", "ha ha ha ha", "xyzxyzxyz",
        "ok 😀😀😀", "abab", "ab" * 7, "a\n", "tail" + "!" * 50, "xyxyxy\n", "é" * 3,
        "<think>\nx\n</think>\n<answer>\ny\n</answer>", "<think>\nx\n</think>\n<answer>\ny\n</answer>\n",
        "<think>\nx\n</think>\n<answer>\ny\n</answer>\n\n", "<think>\nx\n</think>\n<answer>\ny\n</answer>\r",
        "<think>\nx\n</think>\n<answer>\ny\n</answer> ", " <think>\nx\n</think>\n<answer>\ny\n</answer>",
        "<think>x</think><answer>y</answer>", "1. a\n2. b\n- c\n* d", "\n-\n-\n-", "Step 1: go\nFirst, Next, Finally,",
        "<think>\na\n</think>\n<answer>\n```python\nprint(1)\n```\n</answer>\nmore text",
        "<think>\na\n</think>\n<answer>\n```python\nx\n```\n</answer>",
        "<think>\na\n</think>\n<answer>\nno code\n</answer>",
        "x ```python\nfirst```, then ```python\nsecond``` end", "The the THE the the cat cat"]


# --- fixed values: patterns and fences of the reward rules, as the rules state them ---
STEP_MARKERS = r"(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
FORMAT_RULE = r"<think>\n.*\n</think>\n<answer>\n.*\n</answer>"
CODE_FORMAT_RULE = r"^<think>\n.*?\n</think>\n<answer>\n.*?```python.*?```.*?\n</answer>$"
OPEN_FENCE, CLOSE_FENCE = "```python\n", "```"
# --- end of fixed values ---


def stutter_model(text, min_repeat=3, max_len=5):
    for length in range(1, max_len + 1):
        if len(text) < length:
            continue
        unit = text[-length:]
        k = 0
        while text.endswith(unit * (k + 1)):
            k += 1
        if k >= min_repeat:
            return text[: len(text) - k * length]
    return text


def format_model(t):
    body = t[:-1] if t.endswith("\n") else t
    return 1.0 if re.fullmatch(FORMAT_RULE, body, re.S) else 0.0


def tags_model(t):
    return sum(0.25 for tag in TX.TAGS if t.count(tag) == 1)


def steps_model(t):
    return min(1.0, len(re.findall(STEP_MARKERS, t)) / 3)


def code_model(t):
    """Body of the last fence: from each opening fence to the next closing one."""
    at, body = 0, ""
    while (start := t.find(OPEN_FENCE, at)) >= 0:
        end = t.find(CLOSE_FENCE, start + len(OPEN_FENCE))
        if end < 0:
            break
        body, at = t[start + len(OPEN_FENCE):end], end + len(CLOSE_FENCE)
    return body


def code_format_model(t):
    return 1.0 if re.match(CODE_FORMAT_RULE, t, re.S | re.M) else 0.0


def rep_model(t, n=3, pen=-1.0):
    """Share of repeated word n-grams times the penalty, by index."""
    words = t.lower().split()
    total = len(words) - n + 1
    if total < 1:
        return 0.0
    seen = set()
    for i in range(total):
        seen.add(" ".join(words[i:i + n]))
    return (total - len(seen)) / total * pen + 0.0


@pytest.fixture(scope="module")
def edge_df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGE)], "id int, t string")


def _col(edge_df, expr):
    return [r[0] for r in edge_df.orderBy("id").select(expr).collect()]


def test_stutter(edge_df):
    assert _col(edge_df, TX.remove_stutter(F.col("t"))) == [stutter_model(t) for t in EDGE]


def test_stutter_long_run(spark):
    t = "x" + "ab" * 200000
    got = spark.createDataFrame([(t,)], "t string").select(TX.remove_stutter(F.col("t"))).first()[0]
    assert got == stutter_model(t) == "x"


def test_format(edge_df):
    assert _col(edge_df, TX.format_reward(F.col("t"))) == [format_model(t) for t in EDGE]


def test_tags(edge_df):
    assert _col(edge_df, TX.tag_count_reward(F.col("t"))) == [tags_model(t) for t in EDGE]


def test_steps(edge_df):
    assert _col(edge_df, TX.reasoning_steps_reward(F.col("t"))) == pytest.approx([steps_model(t) for t in EDGE])


def test_code(edge_df):
    assert _col(edge_df, TX.extract_code(F.col("t"))) == [code_model(t) for t in EDGE]


def test_code_format(edge_df):
    assert _col(edge_df, TX.code_format_reward(F.col("t"))) == [code_format_model(t) for t in EDGE]


def test_repetition(edge_df):
    assert _col(edge_df, TX.repetition_penalty(F.col("t"))) == pytest.approx([rep_model(t) for t in EDGE])
    with pytest.raises(ValueError):
        TX.repetition_penalty(F.col("t"), 3, 0.5)


def test_dapo_clean(spark):
    from rolloutlens.sources.fixtures import DAPO_HEAD, DAPO_TAIL
    q = "What is 1+1?\nSecond line."
    df = spark.createDataFrame([(DAPO_HEAD + q + DAPO_TAIL,)], "t string")
    assert df.select(TX.clean_dapo_question(F.col("t"))).first()[0] == q


def test_length_kinds(edge_df):
    chars = _col(edge_df, TX.length_column(F.col("t"), "chars"))
    wds = _col(edge_df, TX.length_column(F.col("t"), "words"))
    tok = _col(edge_df, TX.length_column(F.col("t"), lambda s: s.split()))
    assert chars == [len(t) for t in EDGE]
    assert wds == [len(t.lower().split()) for t in EDGE]
    assert tok == [len(t.split()) for t in EDGE]
    with pytest.raises(ValueError):
        TX.length_column(F.col("t"), "bytes")
