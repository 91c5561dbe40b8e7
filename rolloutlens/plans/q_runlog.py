"""Queries: run logs -> metric points -> series -> rolling means; metrics sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runlog as RL
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources import sinks as SK
from ..session import scratch_path
from . import oracle as O
from .catalog import r9, register


def _m(acc, major, reward, length):
    return (f"'平均正确率：' || printf('%.6f', {acc}) || '，多数投票正确率：' || printf('%.6f', {major}) || "
            f"'，平均奖励：' || printf('%.6f', {reward}) || '，平均长度：' || {length}")


def _f6(x):
    return f"printf('%.6f', {x})"


ACC, MAJ = "((value % 10) / 10)", "((user_id % 10) / 10.0)"
LENGTH = "CASE WHEN event_id % 50 = 7 THEN 'n/a' ELSE printf('%.6f', value * 3) END"
N = "CAST(256 + event_id % 7 AS VARCHAR)"
LOGS = f"""ev AS (SELECT event_type || '-' || CAST(event_id // 16384 AS VARCHAR) AS run, event_id, user_id, value FROM events),
lines AS (
  SELECT run, -1 AS k1, 0 AS k2, {_m('v / 100', 'v / 200', 'v / 50', _f6('v'))} AS line
  FROM (SELECT run, avg(value) AS v FROM ev GROUP BY run)
  UNION ALL SELECT run, event_id, 0, '' FROM ev
  UNION ALL SELECT run, event_id, 1, {O.lit(RL.CYCLE_BANNER)} FROM ev
  UNION ALL SELECT run, event_id, 2, {_m(ACC, MAJ, f'{ACC} + event_id % 2', LENGTH)} || '，收集轨迹数量：' || {N} FROM ev
  UNION ALL SELECT run, event_id, 3, {_m(ACC, MAJ, f'{ACC} + event_id % 2', LENGTH)} FROM ev
  UNION ALL SELECT run, event_id, 4, '已写入' || {N} || '条样本到缓冲区' FROM ev
  UNION ALL SELECT run, event_id, 5, {_m('((value % 7) / 7)', '((user_id % 4) / 4.0)', '((value % 7) / 7) + 0.5', _f6('value * 2'))} FROM ev
  UNION ALL SELECT run, event_id, 6, '周期完成，耗时: 0h 0m 1.00s' FROM ev),
logs AS (SELECT run, string_agg(line, chr(10) ORDER BY k1, k2) || chr(10) AS log FROM lines GROUP BY run)"""


def _pts(pattern: str, name: str) -> str:
    arr = [f"regexp_extract_all(log, {O.lit(pattern)}, {i})" for i in range(1, 5)]
    return f"""{name} AS (SELECT run, unnest(range(0, len({arr[0]}))) AS point,
  {', '.join(f"TRY_CAST(unnest({a}) AS DOUBLE) AS {f}" for a, f in zip(arr, RL.FIELDS))} FROM logs)"""


POINTS = f"""{LOGS},
{_pts(RL.TRAIN_POINTS, 'tr')},
{_pts(RL.INITIAL_TEST_POINTS, 't0')},
{_pts(RL.CYCLE_TEST_POINTS, 't1')},
points AS (
  SELECT run, 'train' AS phase, point, acc, major, reward, length FROM tr
  UNION ALL SELECT run, 'test', point, acc, major, reward, length FROM t0
  UNION ALL SELECT t1.run, 'test', t1.point + coalesce(c.n, 0), acc, major, reward, length
  FROM t1 LEFT JOIN (SELECT run, count(*) AS n FROM t0 GROUP BY run) c USING (run))"""

SERIES_SQL = ",\n".join(
    f"('{name}', '{phase}', '{v}')" for name, phase, v in RL.SERIES)
LONG = f"""{POINTS},
sdef AS (SELECT * FROM (VALUES {SERIES_SQL}) AS s(series, phase, v)),
long AS (
  SELECT run, series, point, point * 4 AS step,
         CASE v WHEN 'format' THEN reward - acc WHEN 'acc' THEN acc WHEN 'major' THEN major ELSE length END AS value
  FROM points JOIN sdef USING (phase))"""


def _logs(spark, sf_dir):
    path = scratch_path(spark, "runlogs")
    FX.write_run_logs(FX.run_log_lines(spark, sf_dir), path)
    return RD.read_run_logs(spark, path)


@register("s7_read_run_logs", f"""WITH {LOGS}
SELECT run, length(log) AS chars, len(string_split(log, chr(10))) - 1 AS lines FROM logs""")
def s7_read_run_logs(spark, sf_dir):
    """Run logs written one file per run, read back line by line."""
    return _logs(spark, sf_dir).groupBy("run").agg(F.sum(F.length("line") + 1).cast("long").alias("chars"),
                                                   F.count(F.lit(1)).alias("lines"))


@register("l1_train_points", f"""WITH {POINTS}
SELECT run, point, acc, major, reward, length FROM points WHERE phase = 'train'""")
def l1_train_points(spark, sf_dir):
    """L1: metric line directly followed by the 'written N records' line."""
    p = RL.log_points(_logs(spark, sf_dir)).filter(F.col("phase") == "train")
    return p.select("run", "point", *RL.FIELDS)


@register("l2_l3_test_points", f"""WITH {POINTS}
SELECT run, point, acc, major, reward, length FROM points WHERE phase = 'test'""")
def l2_l3_test_points(spark, sf_dir):
    """L2 + L3 + U3: the initial test point(s), then one per finished cycle."""
    p = RL.log_points(_logs(spark, sf_dir)).filter(F.col("phase") == "test")
    return p.select("run", "point", *RL.FIELDS)


@register("l4_l5_metric_series", f"""WITH {LONG}
SELECT run, series, point, step, {O.r9('value')} AS value FROM long""")
def l4_l5_metric_series(spark, sf_dir):
    """L4 + L5: the eight series with the step axis."""
    s = RL.series_long(RL.log_points(_logs(spark, sf_dir)))
    return s.select("run", "series", "point", "step", r9("value").alias("value"))


@register("w3_rolling_mean", f"""WITH {LONG}
SELECT run, series, point, {O.r9('value')} AS value,
       {O.r9('CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END')} AS smooth
FROM long WINDOW w AS (PARTITION BY run, series ORDER BY point ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def w3_rolling_mean(spark, sf_dir):
    """5-point rolling mean of every series (first 4 points empty)."""
    s = RL.series_long(RL.log_points(_logs(spark, sf_dir)))
    r = RL.rolling_mean(s, ["run", "series"])
    return r.select("run", "series", "point", r9("value").alias("value"), r9("smooth").alias("smooth"))


@register("s8_metrics_sink", f"""WITH {POINTS},
lp AS (SELECT run, phase, CAST(point AS BIGINT) AS step, unnest(['acc', 'major', 'reward', 'length']) AS metric,
              unnest([acc, major, reward, length]) AS value FROM points)
SELECT run, phase, step, metric, {O.r9('value')} AS value FROM lp""")
def s8_metrics_sink(spark, sf_dir):
    """Metric points appended to a metrics table (run, phase, step,
    metric, value) in the shared folder - one distributed write - then
    read back."""
    pts = RL.log_points(_logs(spark, sf_dir))
    path = scratch_path(spark, "metrics")
    rows = SK.metrics_long(pts, RL.FIELDS, step="point")
    for _ in range(2):  # the second write is a retry of the first
        SK.append_metrics(rows, path, batch=0)
    back = spark.read.parquet(path)
    return back.select("run", "phase", "step", "metric", r9("value").alias("value"))
