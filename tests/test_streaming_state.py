"""ST1 on keyed state: restarts, redelivered and late rows, timers, open groups from the state alone."""
import datetime as dt
import random

from pyspark.sql import functions as F

from rolloutlens.config import RunConfig
from rolloutlens.plans.scoring import buffer_rows, score
from rolloutlens.session import scratch_path
from rolloutlens.streaming import state as KS

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "prompt_idx long, gen_idx int, gold string, content string, arrival_ts timestamp"
CFG = RunConfig(group_size=4)


def row(p, g, minutes, content=None):
    return p, g, r"\boxed{1}", content or r"\boxed{%d}" % ((p + g) % 2), T0 + dt.timedelta(minutes=minutes)


def deliver(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def folders(spark):
    return [scratch_path(spark, n) for n in ("ks-src", "ks-sink", "ks-ckpt")]


def run(spark, src, sink, ckpt, **args):
    KS.start_collection(spark, src, sink, ckpt, CFG, max_files_per_trigger=1, state_partitions=3, **args).awaitTermination()


def pairs(df):
    return sorted((r.prompt_idx, r.gen_idx) for r in df.collect())


def test_restarted_stream_equals_one_batch(spark):
    src, sink, ckpt = folders(spark)
    rng = random.Random(2)
    rows = [row(p, g, rng.randint(0, 500)) for p in range(12) for g in range(4)]
    late = rows.pop()  # the last generation of prompt 11 never comes
    rng.shuffle(rows)
    seen = []
    for k in range(0, len(rows), 16):  # a run, stopped, after every delivery; rows of the one before come again
        deliver(spark, src, rows[k:k + 16] + rows[max(0, k - 5):k])
        run(spark, src, sink, ckpt)
        seen += rows[k:k + 16]
        count = {p: len({g for q, g, *_ in seen if q == p}) for p, *_ in seen}
        assert sorted(map(tuple, KS.open_groups(spark, ckpt).collect())) == sorted((p, n) for p, n in count.items() if n < 4)
    done = spark.createDataFrame([r for r in rows if r[0] != late[0]], SCHEMA).drop("arrival_ts")
    want = sorted((r.prompt_idx, r.gen_idx, round(r.advantage, 9)) for r in buffer_rows(score(done)).collect())
    assert sorted((r.prompt_idx, r.gen_idx, round(r.advantage, 9)) for r in spark.read.parquet(sink).collect()) == want and want
    assert pairs(spark.read.parquet(f"{sink}/_released")) == sorted((p, g) for p in range(11) for g in range(4))
    assert spark.conf.get(KS.STORE, "") != KS.ROCKSDB  # the session is as before


def test_timer_releases_what_never_completes(spark):
    src, sink, ckpt = folders(spark)
    deliver(spark, src, [row(0, g, g) for g in range(3)])
    deliver(spark, src, [row(0, 1, 8, "a second arrival"), row(9, 0, 8)])  # moves the timer of prompt 9 only: (0, 1) is a repeat
    for p in range(1, 4):
        deliver(spark, src, [row(p, g, 60 * p + g) for g in range(4)])
    run(spark, src, sink, ckpt, watermark="10 minutes", timeout_ms=10 * 60 * 1000)
    assert pairs(spark.read.parquet(f"{sink}/_incomplete")) == [(0, 0), (0, 1), (0, 2), (9, 0)]
    assert KS.open_groups(spark, ckpt).count() == 0
    released = spark.read.parquet(f"{sink}/_released")
    assert released.where("prompt_idx = 0 and gen_idx = 1").select("content").first()[0] != "a second arrival"
    deliver(spark, src, [row(0, 3, 3)])  # long after the watermark: dropped, opens no group
    run(spark, src, sink, ckpt, watermark="10 minutes", timeout_ms=10 * 60 * 1000)
    assert KS.open_groups(spark, ckpt).count() == 0
    assert spark.read.parquet(f"{sink}/_released").where((F.col("prompt_idx") == 0) & F.col("complete")).count() == 0


def test_one_call_takes_all_prompts_of_a_shard():
    import pandas as pd

    class Map(dict):
        iterator, getValue, updateValue, removeKey = dict.items, dict.__getitem__, dict.__setitem__, dict.pop

    class Handle(set):
        registerTimer, deleteTimer = set.add, set.remove

        def getMapState(self, *_):
            return Map()

    def rows(*pairs):
        return pd.DataFrame([row(p, g, p) for p, g in pairs], columns=["prompt_idx", "gen_idx", "gold", "content", "arrival_ts"])
    c, timers = KS.GroupCollector(2, 1000), Handle()
    c.init(timers)
    frames = list(c.handleInputRows((0,), iter([rows((1, 0), (2, 0), (3, 1)), rows((1, 1), (3, 0), (3, 0), (4, 0))]), None))
    assert [[(r.prompt_idx, r.gen_idx, r.complete) for r in f.itertuples()] for f in frames] == [[(1, 0, True), (1, 1, True), (3, 0, True), (3, 1, True)]]
    assert set(c.rows) == {(2, 0), (4, 0)} and len(timers) == 1  # of prompt 2, the earliest
    assert [len(f) for f in c.handleInputRows((0,), iter([rows((2, 1))]), None)] == [2]
    assert set(c.rows) == {(4, 0)} and set(c.deadline) == {(4,)} and timers == {c.deadline[(4,)][0]}
