"""Buffer I/O (S4, S5): JSON lines round trip and the legacy JSON-array file."""
import json
import os

from rolloutlens.session import scratch_path
from rolloutlens.sources import readers as RD
from rolloutlens.sources import sinks as SK


def test_legacy_array_buffer(spark):
    recs = [{"prompt_idx": 1, "gen_idx": 0, "completion": [{"role": "assistant", "content": "答案 \\boxed{2}"}],
             "advantage": 0.5, "reward": 2.0, "label": "\\boxed{2}"},
            {"prompt_idx": 1, "gen_idx": 3, "completion": [{"role": "assistant", "content": "é"}],
             "advantage": 1.25, "reward": 1.0, "label": "\\boxed{2}"}]
    d = scratch_path(spark, "legacy")
    os.makedirs(d)
    with open(os.path.join(d, "buffer.json"), "w", encoding="utf-8") as f:
        json.dump(recs, f, ensure_ascii=False, indent=2)
    back = RD.read_buffer(spark, d, legacy_array=True).orderBy("gen_idx").collect()
    assert [r.completion[0].content for r in back] == ["答案 \\boxed{2}", "é"]
    assert [r.advantage for r in back] == [0.5, 1.25]
    out = scratch_path(spark, "buffer")
    SK.write_buffer(RD.read_buffer(spark, d, legacy_array=True), out)
    again = RD.read_buffer(spark, out).orderBy("gen_idx").collect()
    assert [r.asDict(recursive=True) for r in again] == [r.asDict(recursive=True) for r in back]


def test_code_problems_of_prompts_without_their_first_id(spark, tmp_path):
    from rolloutlens.sources import fixtures as FX
    rows = [(i, "t") for i in (0, 1, 9, 10, 23, 24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = FX.problems_code(spark, str(tmp_path)).collect()
    assert sorted(r.prompt_idx for r in got) == [0, 1, 2, 3]
    assert {len(r.test_cases) for r in got} == {4}
