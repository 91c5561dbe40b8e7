"""All cycles of a run against a plain loop; restarts that skip nothing."""
import random

import pytest

from rolloutlens.config import RunConfig
from rolloutlens.operators import cycles as CY
from rolloutlens.plans.train_cycle import run_cycles
from rolloutlens.sources import sinks as SK


def cfg(int_num, start=0):
    return RunConfig(group_size=4, max_num_seq=16, int_num=int_num, start_idx=start)  # 4 prompts to a batch


def kept_rows(rng, prompts, hot=0):
    rows = [(p, g) for p in range(prompts) for g in range(4) if rng.random() < rng.choice([0.0, 0.2, 0.9])]
    return sorted(set(rows) | {(prompts // 2, g) for g in range(hot)})


def loop(rows, c, cycles=None):
    """The trainer's loop: batch after batch into a buffer until it is full."""
    end, out, start = max((p for p, _ in rows), default=-1) + 1, [], c.start_idx
    per = c.prompts_per_batch
    while start < end and (cycles is None or len(out) < cycles):
        at, buffer, last = start, [], None
        while len(buffer) < c.int_num and at < end:
            stop = (at // per + 1) * per
            got = [r for r in rows if at <= r[0] < stop]
            buffer += got
            last = stop if got else last
            at = stop
        if not buffer:
            break
        out.append((len(out) + 1, start, at if len(buffer) >= c.int_num else last, len(buffer),
                    max(0, c.int_num - len(buffer)), buffer[:c.int_num]))
        start = at
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "prompt_idx long, gen_idx int").repartition(3)


@pytest.mark.parametrize("seed,int_num,start,hot", [(0, 5, 0, 0), (1, 1, 3, 0), (2, 17, 6, 0), (3, 40, 1, 90), (4, 10_000, 0, 0)])
def test_cycles_equal_the_loop(spark, seed, int_num, start, hot):
    rows, c = kept_rows(random.Random(seed), 60, hot), cfg(int_num, start)
    want = loop(rows, c)
    got = sorted(map(tuple, CY.cycle_schedule(frame(spark, rows), c).collect()))
    assert got == [w[:5] for w in want]
    filled = CY.fill_cycles(frame(spark, rows), c).select("cycle", "position", "prompt_idx", "gen_idx").collect()
    assert sorted(map(tuple, filled)) == [(w[0], i + 1, *r) for w in want for i, r in enumerate(w[5])]


def test_a_number_of_cycles(spark):
    rows, c = kept_rows(random.Random(7), 80), cfg(6)
    want = loop(rows, c)
    assert len(want) > 6
    for n in (1, 2, 5):
        assert sorted(map(tuple, CY.cycle_schedule(frame(spark, rows), c, n).collect())) == [w[:5] for w in want[:n]]
        assert CY.fill_cycles(frame(spark, rows), c, n).count() == sum(len(w[5]) for w in want[:n])


def test_no_kept_rows(spark):
    empty = frame(spark, [])
    assert CY.cycle_schedule(empty, cfg(5)).count() == 0 and CY.fill_cycles(empty, cfg(5)).count() == 0
    assert CY.cycle_schedule(frame(spark, [(1, 0)]), cfg(5, 8)).count() == 0  # all before the start


def buffers(spark, out):
    return sorted((r.cycle, r.position, r.prompt_idx, r.gen_idx) for r in spark.read.parquet(f"{out}/buffer").collect())


def test_restarts_skip_nothing_and_take_nothing_twice(spark, tmp_path, monkeypatch):
    rows, c = kept_rows(random.Random(11), 90), cfg(7, 2)
    want = [w for w in loop(rows, c) if not w[4]]
    kept, out = frame(spark, rows), str(tmp_path / "run")
    assert run_cycles(kept, c, out, 3).count() == 3
    # killed between a cycle's buffer and its state row
    written = []
    monkeypatch.setattr(SK, "write_by_cycle", lambda d, path, f=SK.write_by_cycle: (_ for _ in ()).throw(OSError("killed")) if path.endswith("state") else (f(d, path), written.append(path)))
    with pytest.raises(OSError):
        run_cycles(kept, c, out, 5)
    monkeypatch.undo()
    assert written and spark.read.parquet(f"{out}/state").count() == 3 and len({b[0] for b in buffers(spark, out)}) == 5
    state = run_cycles(kept, c, out, 10_000)
    assert sorted((r.cycle, r.start_idx, r.next_start, r.kept, r.shortfall) for r in state.collect()) == [w[:5] for w in want]
    assert buffers(spark, out) == [(w[0], i + 1, *r) for w in want for i, r in enumerate(w[5])]
    again = run_cycles(kept, c, out, 10_000)  # nothing left to do
    assert again.count() == len(want) and len(buffers(spark, out)) == sum(len(w[5]) for w in want)


def test_growing_data_give_the_same_cycles(spark, tmp_path):
    rows, c = kept_rows(random.Random(13), 90), cfg(7)
    want = [w for w in loop(rows, c) if not w[4]]
    out = str(tmp_path / "run")
    for until in (10, 37, 38, 90 + 4):  # arrivals in prompt order; a batch that is cut waits
        run_cycles(frame(spark, [r for r in rows if r[0] < until]), c, out, 10_000, until=until)
    assert buffers(spark, out) == [(w[0], i + 1, *r) for w in want for i, r in enumerate(w[5])]


def test_folders_grow_with_calls_not_with_cycles(spark, tmp_path):
    rows, c = kept_rows(random.Random(17), 90), cfg(3)
    want, out = [w for w in loop(rows, c) if not w[4]], tmp_path / "run"
    kept = frame(spark, rows)
    run_cycles(kept, c, str(out), 2)
    assert run_cycles(kept, c, str(out), 10_000).count() == len(want) > 20
    for part in ("buffer", "state"):
        assert len([d for d in (out / part).iterdir() if d.is_dir()]) == 2
    assert buffers(spark, str(out)) == [(w[0], i + 1, *r) for w in want for i, r in enumerate(w[5])]
