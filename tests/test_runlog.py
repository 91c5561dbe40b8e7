"""Run-log parsing (L1-L3, U3, W3) against Python's re on a hand-built log."""
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolloutlens.operators import runlog as RL
from rolloutlens.sources import fixtures as FX
from rolloutlens.sources import sinks as SK


def metric(a, m, r, l, n=None):
    s = f"平均正确率：{a}，多数投票正确率：{m}，平均奖励：{r}，平均长度：{l}"
    return s + (f"，收集轨迹数量：{n}" if n is not None else "")


def build_log(cycles=7):
    lines = [metric(0.1, 0.2, 0.3, 100.5)]
    for c in range(cycles):
        lines += ["", RL.CYCLE_BANNER, "--- 开始采样阶段 ---", metric(c / 10, c / 20, c / 5, 50 + c, 192),
                  metric(c / 10 + 0.01, c / 20, c / 5 + 1, 51 + c, 256), "结束采样下标： 30",
                  metric(c / 10 + 0.02, c / 20, c / 5 + 1.5, 52 + c), f"已写入{256 + c}条样本到缓冲区",
                  metric(c / 7, c / 9, c / 7 + 0.5, 60 + c), "周期完成，耗时: 0h 1m 2.00s"]
    return "\n".join(lines) + "\n"


def as_lines(spark, log, per_split):
    """The log as read line by line, cut into splits of ``per_split`` lines."""
    rows = [("run1", "f", 100 * (i // per_split), i, x) for i, x in enumerate(log.split("\n")[:-1])]
    return spark.createDataFrame(rows, "run string, file string, block long, seq long, line string").repartition(3)


@pytest.mark.parametrize("per_split", [1, 2, 3, 7, 1000])
def test_points_match_python_re(spark, per_split):
    log = build_log()
    pts = RL.log_points(as_lines(spark, log, per_split)).toPandas()
    train = re.findall(RL.TRAIN_POINTS, log)
    test = re.findall(RL.INITIAL_TEST_POINTS, log) + re.findall(RL.CYCLE_TEST_POINTS, log)
    for phase, want in (("train", train), ("test", test)):
        got = pts[pts.phase == phase].sort_values("point")
        assert list(got.point) == list(range(len(want)))
        assert [tuple(r) for r in got[list(RL.FIELDS)].itertuples(index=False)] == \
               [tuple(float(x) for x in w) for w in want]


def test_rolling_mean_matches_pandas(spark):
    log = build_log(12)
    s = RL.series_long(RL.log_points(as_lines(spark, log, 9)))
    got = RL.rolling_mean(s, ["run", "series"]).toPandas()
    for series, g in got.groupby("series"):
        g = g.sort_values("point")
        want = pd.Series(list(g.value)).rolling(window=5).mean()
        assert [None if pd.isna(x) else pytest.approx(x) for x in want] == \
               [None if pd.isna(x) else x for x in g.smooth]


@pytest.mark.parametrize("chunk", [3, 5, 64])
def test_rolling_mean_with_nulls_and_chunk_borders(spark, chunk):
    values = [float(k * k % 17) for k in range(40)]
    values[6] = values[21] = None
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(values)], "series string, point long, value double")
    got = [r.smooth for r in RL.rolling_mean(df, "series", chunk=max(chunk, 4)).orderBy("point").collect()]
    want = pd.Series(values, dtype=float).rolling(window=5).mean()
    assert [None if pd.isna(x) else pytest.approx(x) for x in want] == got


def test_files_are_read_line_by_line_and_whole(spark, tmp_path):
    from rolloutlens.sources import readers as RD
    log = build_log(5)
    for run in ("a", "b"):
        (tmp_path / f"run={run}").mkdir()
        (tmp_path / f"run={run}" / "part-0").write_text(log, encoding="utf-8")
    lines = RD.read_run_logs(spark, str(tmp_path))
    pts = RL.log_points(lines).groupBy("run", "phase").count().collect()
    assert sorted((r["run"], r["phase"], r["count"]) for r in pts) == [(x, p, n) for x in "ab" for p, n in (("test", 6), ("train", 5))]
    assert [r.log for r in RD.read_run_logs(spark, str(tmp_path), whole=True).collect()] == [log, log]


def test_points_are_spread_over_tasks_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(RL, "TASK_POINTS", 40)
    pts = RL.log_points(as_lines(spark, build_log(300), 7))
    rows = SK.metrics_long(pts, RL.FIELDS, step="point").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in rows) == 4 * 601 and max(r["count"] for r in rows) <= 3 * 4 * 40


def test_written_logs_are_spread_over_tasks_by_their_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FX, "LOG_TASK_LINES", 7 * 100)
    FX.write_run_logs(FX.run_log_lines(spark, "/root/testdata/sf0.001"), str(tmp_path / "logs"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    files = list((tmp_path / "logs").glob("run=*/part-*"))
    assert len(files) == events.select("event_type").distinct().count()
    assert len({f.name.split("-")[1] for f in files}) > 1  # written by different tasks
    banners = {f.parent.name[4:-2]: f.read_text(encoding="utf-8").count(RL.CYCLE_BANNER) for f in files}
    assert banners == {r["event_type"]: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_splits_are_written_with_their_points_and_not_with_their_lines(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(RL, "materialize", lambda d, name, f=RL.materialize: made.setdefault(name, f(d, name)))
    assert RL.log_points(as_lines(spark, build_log(50), 20)).count() == 101
    rows = made["log-splits"].collect()
    assert max(max(len(r["head"]), len(r["tail"])) for r in rows) <= 2 and "recs" not in rows[0]
    assert sum(len(r["points"]) for r in rows) == 76  # the other 25 lie across borders
