"""JSON arrays cut at every byte against the json module and Spark's whole-file reader."""
import json
import random

import pyarrow as pa
import pytest

from rolloutlens import schemas
from rolloutlens.sources import json_array as J
from rolloutlens.sources import readers as RD

HARD = [{"a": "x, y [ ] { } : \" end"}, {"b": "\\", "c": "\\\\\""}, [], [[1, [2, ","]], "]"], "plain, with \"quotes\" and \\", 12, None, True,
        {}, {"k": {"k": [{"k": "ü日本☃𝄞"}, "}"]}}, "", {"n": [1, 2, [3, {"m": "],[\\\"" * 3}]]}, "\\\\\\", "ends with a backslash \\"]


def by_ranges(text: bytes, path, size):
    """As the two passes do it, without Spark."""
    path.write_bytes(text)
    out, odd, depth = [], 0, 0
    starts = list(range(0, len(text), size))
    batch = pa.RecordBatch.from_pydict({"file": [str(path)] * len(starts), "start": starts, "end": [min(len(text), s + size) for s in starts]})
    for b in J._summaries([batch]):
        for r in b.to_pylist():
            with J.Bytes(r["file"]) as f:
                out += list(J._elements(f, r["start"], r["end"], bool(odd), depth))
            depth += r["inside"] if odd else r["outside"]
            odd = (odd + r["odd"]) % 2
    assert (odd, depth) == (0, 0)
    return out


@pytest.mark.parametrize("form", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": "\t"}])
def test_cut_at_every_byte(tmp_path, monkeypatch, form):
    monkeypatch.setattr(J, "AHEAD", 7)
    text = json.dumps(HARD, **form).encode()
    whole = by_ranges(text, tmp_path / "x.json", len(text))
    assert [json.loads(t) for _, t in whole] == HARD and [p for p, _ in whole] == sorted({p for p, _ in whole})
    for size in [*range(1, 40), len(text) // 2, len(text) - 1]:
        assert by_ranges(text, tmp_path / "x.json", size) == whole, size


@pytest.mark.parametrize("text", [b"", b"[]", b" \n[ \n ] \n", b"\xef\xbb\xbf[1, 2]", b"[\"" + b"\\\\" * 500 + b"\", \"" + b"\\\"" * 333 + b"\"]", b"[1]"])
def test_small_and_odd_files(tmp_path, monkeypatch, text):
    monkeypatch.setattr(J, "AHEAD", 5)
    want = json.loads(text.decode("utf-8-sig")) if text.strip() else []
    for size in (1, 2, 3, 10, 10_000):
        assert [json.loads(t) for _, t in by_ranges(text, tmp_path / "x.json", size)] == want


def random_value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return "".join(rng.choice('ab"\\,[]{}: \né☃') for _ in range(rng.randint(0, 30)))
    if kind < 4:
        return rng.choice([None, True, 1, -2.5, 10**18])
    if kind < 6:
        return {str(k): random_value(rng, depth + 1) for k in range(rng.randint(0, 4))}
    return [random_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]


@pytest.mark.parametrize("seed", range(5))
def test_random_arrays(tmp_path, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(J, "AHEAD", rng.choice([3, 50]))
    value = [random_value(rng) for _ in range(60)]
    text = json.dumps(value, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5).encode()
    for size in rng.sample(range(1, 400), 6):
        assert [json.loads(t) for _, t in by_ranges(text, tmp_path / "x.json", size)] == value


def test_buffers_equal_the_whole_file_reader(spark, tmp_path):
    rng = random.Random(1)
    for k in range(4):
        rows = [{"prompt_idx": p, "gen_idx": g, "completion": [{"role": "assistant", "content": random_value(rng, 9) if p % 2 else 'say "[1, 2]" \\'}],
                 "advantage": rng.random(), "reward": None, "label": "\\boxed{1,2}"} for p in range(k * 20) for g in range(2)]
        (tmp_path / f"b{k}.json").write_text(json.dumps(rows, indent=4, ensure_ascii=False), encoding="utf-8")
    path = str(tmp_path)
    want = sorted(map(str, spark.read.schema(schemas.BUFFER).option("multiLine", "true").json(path).collect()))
    assert len(want) == 240
    for size in (100, 5000, J.RANGE_BYTES):
        got = J.read_json_array(spark, path, schemas.BUFFER, size)
        assert sorted(map(str, got.collect())) == want
    assert RD.read_buffer(spark, path, legacy_array=True).count() == 240
    offsets = J.array_elements(spark, path, 100).orderBy("file", "offset").collect()  # the order of the elements is kept
    assert [json.loads(r["value"])["prompt_idx"] for r in offsets if r["file"].endswith("b3.json")] == [p for p in range(60) for _ in range(2)]


def test_one_array_is_read_in_many_tasks(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps([{"prompt_idx": i, "label": "x" * 200} for i in range(5000)], indent=1))
    d = J.read_json_array(spark, str(tmp_path), schemas.BUFFER, 1 << 16)
    from pyspark.sql import functions as F
    used = d.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(used) > 4 and sum(r["count"] for r in used) == 5000
