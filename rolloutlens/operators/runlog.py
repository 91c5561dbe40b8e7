"""Run-log analytics (L1-L5, W3, U3): log lines -> metric series.

A run log is read line by line (S7): (run, file, block, seq, line); ``seq``
counts up by one inside a split of a file. A point is a metric line that a fixed
marker line follows. The text is scanned once: the lines of a split that may be
part of a point are neighbours in one row, as numbers and flags, and that row
gives the points inside the split before it is written; of the lines only the
first two and the last two of the split are kept. What follows works on that
table, a row per split: a split's last two lines are handed to the next one,
which makes the points that lie across the border, and points are numbered by
the counts of earlier splits. No task holds a whole run, and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import materialize
from . import ordered

# --- fixed values: the trainer's log lines and the patterns that read them ---
CYCLE_BANNER = "=== 开始新的迭代周期 ==="
METRIC_PREFIX = "平均正确率："
_M = METRIC_PREFIX + "(.*?)，多数投票正确率：(.*?)，平均奖励：(.*?)，平均长度：(.*?)"
TRAIN_POINTS = _M + r"\n已写入.*?条样本到缓冲区"
INITIAL_TEST_POINTS = _M + r"\n\n=== 开始新的迭代周期 ==="
CYCLE_TEST_POINTS = _M + r"\n周期完成"
METRIC_LINE = _M + r"\z"
WRITTEN_START = "已写入"
WRITTEN_LINE = "^已写入.*?条样本到缓冲区"
CYCLE_DONE = "周期完成"
SERIES = (  # (name, phase, value)
    ("Train Format Reward", "train", "format"), ("Train Accuracy Reward", "train", "acc"),
    ("Train Major Vote Accuracy", "train", "major"), ("Train Length", "train", "length"),
    ("Test Format Reward", "test", "format"), ("Test Accuracy Reward", "test", "acc"),
    ("Test Major Accuracy", "test", "major"), ("Test Length", "test", "length"),
)
# --- end of fixed values ---

FIELDS = ("acc", "major", "reward", "length")


SPLIT = ["run", "file", "block"]
WRITTEN, BANNER, DONE, BLANK = range(4)


def split_records(lines: DataFrame) -> DataFrame:
    """A row per split: run, file, block, first, last (seq of its lines) and
    ``recs``, its lines that may be part of a point, in order: seq, mark (what
    follows a point), metric (whether it is a metric line) and its numbers.
    One scan; a split is read by one task, so its row is made before the shuffle."""
    line = F.col("line")
    mark = (F.when(line == "", BLANK).when(F.startswith(line, F.lit(CYCLE_BANNER)), BANNER)
             .when(F.startswith(line, F.lit(CYCLE_DONE)), DONE)
             .when(F.startswith(line, F.lit(WRITTEN_START)) & line.rlike(WRITTEN_LINE), WRITTEN))
    # one search per line: a metric line becomes its four texts, a line each
    texts = F.when(F.contains(line, F.lit(METRIC_PREFIX)), F.split(F.regexp_replace(line, "(?s:^.*?)(?d)" + METRIC_LINE, "$1\n$2\n$3\n$4"), "\n"))
    d = lines.select(*SPLIT, "seq", mark.alias("mark"), texts.alias("texts"))
    d = d.select(*SPLIT, "seq", "mark", "texts", F.coalesce(F.size("texts") == len(FIELDS), F.lit(False)).alias("metric"))
    rec = F.struct("seq", "mark", "metric", *[F.when(F.col("metric"), F.get("texts", F.lit(i))).try_cast("double").alias(f) for i, f in enumerate(FIELDS)])
    return d.groupBy(*SPLIT).agg(F.min("seq").alias("first"), F.max("seq").alias("last"),
                                 F.sort_array(F.collect_list(F.when(F.col("mark").isNotNull() | F.col("metric"), rec))).alias("recs"))


def _inside(records: DataFrame) -> DataFrame:
    """Of ``split_records`` what is written: first, last, the points inside the
    split, and those of its first two (``head``) and last two lines (``tail``)
    that may be part of a point."""
    head = F.filter(F.slice("recs", 1, 2), lambda r: r["seq"] <= F.col("first") + 1)
    tail = F.filter(F.slice("recs", F.greatest(F.size("recs") - 1, F.lit(1)), F.lit(2)), lambda r: r["seq"] >= F.col("last") - 1)
    return records.select(*SPLIT, "first", "last", _points("recs").alias("points"), head.alias("head"), tail.alias("tail"))


def _with_tails(splits: DataFrame) -> DataFrame:
    """Points and ``head`` of every split, this after those of the last two lines
    before it, which get the places that they would have in this split."""
    t = splits.select(*SPLIT, "first", "last", (F.col("last") - F.col("first") + 1).alias("n"), "tail")
    w = Window.partitionBy("run", "file").orderBy("block")  # a row per split
    for c in ("last", "n", "tail"):
        t = t.withColumn(f"{c}1", F.lag(c).over(w))
    for c in ("last", "tail"):
        t = t.withColumn(f"{c}2", F.lag(c, 2).over(w))

    def moved(tail, last, back):
        return F.transform(tail, lambda r: r.withField("seq", F.col("first") - back - (F.col(last) - r["seq"])))
    none = F.filter("tail", lambda r: F.lit(False))
    one = F.coalesce(moved(F.col("tail1"), "last1", 1), none)
    two = F.when(F.col("n1") == 1, moved(F.filter("tail2", lambda r: r["seq"] == F.col("last2")), "last2", 2))  # a split of one line before
    ghosts = t.select(*SPLIT, F.sort_array(F.concat(one, F.coalesce(two, none))).alias("ghosts"))
    return splits.join(ghosts, SPLIT).select(*SPLIT, "first", "points", F.concat("ghosts", "head").alias("head"))


def _points(recs: str, border: bool = False) -> Column:
    """The points of ``recs``: part (0 before L1's marker, 1 L2's, 2 L3's) and the
    numbers; with ``border`` those that begin before the split and end in it."""
    first = F.col("first")

    def point(r, i):
        p, q = F.get(recs, i + 1), F.get(recs, i + 2)  # the list is a column of the row, so a place costs no list
        banner = (p["mark"] == BLANK) & (q["mark"] == BANNER) & (q["seq"] == r["seq"] + 2) & (q["seq"] >= first)
        part = F.when(p["mark"] == WRITTEN, 0).when(p["mark"] == DONE, 2)
        part = F.when(p["seq"] == r["seq"] + 1, F.when(banner, 1).when(p["seq"] >= first, part))
        begins = r["metric"] & (r["seq"] < first) if border else r["metric"]
        return F.when(begins, F.struct(part.alias("part"), *[r[f].alias(f) for f in FIELDS]))
    return F.filter(F.transform(recs, point), lambda x: x["part"].isNotNull())


#: Points that a task writes or hands on, about.
TASK_POINTS = 1 << 16


def log_points(lines: DataFrame) -> DataFrame:
    """L1-L3 + U3: (run, phase, point, acc, major, reward, length).

    train = L1: a metric line before a "written" line. test = L2 (before a
    blank line and the cycle banner) and then L3 (before a "cycle done" line),
    the point number counting on across both parts (U3). The points are spread
    over tasks by their number, so what a task makes of them does not grow."""
    splits = materialize(_inside(split_records(lines)), "log-splits")
    def count(part):
        return F.size(F.filter("points", lambda x: x["part"] == part)).cast("long")
    d = _with_tails(splits).select(*SPLIT, F.concat(_points("head", border=True), "points").alias("points"))
    d = materialize(d.select("*", *[count(k).alias(f"n{k}") for k in range(3)]), "log-points")
    counts = d.select(*SPLIT, *[f"n{k}" for k in range(3)])  # a row per split
    total = counts.agg(F.sum(F.col("n0") + F.col("n1") + F.col("n2"))).first()[0] or 0
    d = d.select(*SPLIT, "points").repartition(max(-(-total // TASK_POINTS), 1), *SPLIT)
    run = Window.partitionBy("run")
    before = run.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.sum(f"n{k}").over(before), F.lit(0)) for k in range(3)]
    starts = counts.select(*SPLIT, start[0].alias("s0"), start[1].alias("s1"), (start[2] + F.sum("n1").over(run)).alias("s2"))
    numbered = d.join(starts, SPLIT)
    def numbers(k):
        return F.transform(F.filter("points", lambda x: x["part"] == k), lambda x, i: x.withField("point", F.col(f"s{k}") + i))
    parts = F.concat(*map(numbers, range(3)))
    p = numbered.select("run", F.explode(parts).alias("p"))
    return p.select("run", F.when(F.col("p.part") == 0, "train").otherwise("test").alias("phase"),
                    F.col("p.point").cast("long").alias("point"), *[F.col(f"p.{f}").alias(f) for f in FIELDS])


def series_long(points: DataFrame, run: str = "run", step: int | None = None) -> DataFrame:
    """L4 + L5: the eight plotted series in long form with the step axis
    (point x optimiser steps per cycle). The format series is reward -
    accuracy, which is the format reward only when both weights are 1."""
    step = step if step is not None else C.INT_NUM * C.REP_NUM // (
        C.NUM_DEVICES * C.PER_DEVICE_BATCH * C.GRAD_ACCUM)
    value = {"format": F.col("reward") - F.col("acc"), "acc": F.col("acc"),
             "major": F.col("major"), "length": F.col("length")}
    of = {phase: F.array(*[F.struct(F.lit(name).alias("series"), value[v].alias("value")) for name, p, v in SERIES if p == phase])
          for phase in ("train", "test")}
    x = points.select(run, "point", F.explode(F.when(F.col("phase") == "train", of["train"]).otherwise(of["test"])).alias("s"))
    return x.select(run, "s.series", "point", (F.col("point") * step).alias("step"), "s.value")


def rolling_mean(df: DataFrame, keys, point: str = "point", value: str = "value",
                 window: int = C.ROLLING_WINDOW, out: str = "smooth", chunk: int = ordered.CHUNK) -> DataFrame:
    """Mean of the last ``window`` points; NULL unless all of them are
    there and not NULL (so for the first ``window`` - 1).

    The window runs inside chunks of a series; the last ``window`` - 1 points
    of a chunk also travel, as ghosts, into the next, so a long series is
    spread over many tasks."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    carried = F.col(point) % chunk >= chunk - (window - 1)
    d = df.withColumn("_copy", F.explode(F.when(carried, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    d = d.withColumn("_chunk", ordered.chunk_of(point, chunk) + F.col("_copy"))
    w = Window.partitionBy(*keys, "_chunk").orderBy(point).rangeBetween(-(window - 1), 0)
    mean = F.when(F.count(value).over(w) == window, F.avg(value).over(w))
    return d.withColumn(out, mean).where("_copy = 0").drop("_copy", "_chunk")
