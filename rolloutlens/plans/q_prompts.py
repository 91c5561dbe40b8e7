"""Queries: problem sources, prompts, message lists, joins, buffer I/O, code pass rate."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as TX
from ..operators import prompts as P
from ..operators import rewards as R
from ..sources import fixtures as FX
from ..sources import readers as RD
from ..sources import sinks as SK
from ..session import scratch_path
from . import oracle as O
from .catalog import r9, register
from .q_batching import KEPT_ALL_SQL, KEPT_SQL, _filled, _kept

BOX = "'\\boxed{' || CAST(item_id AS VARCHAR) || '}'"


@register("s1_read_problems", """SELECT item_id AS row_id, text AS problem, CAST(item_id AS VARCHAR) AS answer
FROM benchmark""")
def s1_read_problems(spark, sf_dir):
    """Problem set read with a declared schema (test form)."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
    b = RD.read_problems(spark, FX.table_path(sf_dir, "benchmark"), schema=schema)
    return b.select(F.col("item_id").alias("row_id"), F.col("text").alias("problem"),
                    F.col("item_id").cast("string").alias("answer"))


@register("s2_lowercase_columns", "SELECT item_id AS id, text AS question FROM benchmark")
def s2_lowercase_columns(spark, sf_dir):
    """Capitalised source columns (AIME-history form) lower-cased on read."""
    b = FX.read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ID"),
                                                         F.col("text").alias("Question"))
    return RD.lower_columns(b)


def _sf_problems(spark, sf_dir):
    return {
        "dapo": FX.problems_dapo(spark, sf_dir),
        "xr1": FX.read_table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("row_id"), F.col("text").alias("problem"),
            F.concat(F.lit("The answer is $"), F.col("item_id").cast("string"), F.lit("$.")).alias("solution")),
        "aime": FX.read_table(spark, sf_dir, "benchmark").select(
            F.col("item_id").alias("row_id"), F.col("text").alias("question"),
            F.col("item_id").cast("string").alias("answer")),
        "test": FX.problems_test(spark, sf_dir),
    }


@register("p1_clean_dapo_question", "SELECT item_id AS row_id, text AS question FROM benchmark")
def p1_clean_dapo_question(spark, sf_dir):
    """The DAPO boilerplate removed from wrapped questions gives back the text."""
    d = FX.problems_dapo(spark, sf_dir)
    return d.select("row_id", P.question("dapo").alias("question"))


@register("p2_question_by_adapter", f"""
SELECT a.adapter, item_id AS row_id, text AS question,
       CASE WHEN a.adapter = 'xr1' THEN 'The answer is $' || CAST(item_id AS VARCHAR) || '$.' ELSE {BOX} END AS gold
FROM benchmark, (VALUES ('dapo'), ('xr1'), ('aime'), ('test')) AS a(adapter)""")
def p2_question_by_adapter(spark, sf_dir):
    """P2 + P5: question and gold label for each adapter form."""
    out = None
    for adapter, df in _sf_problems(spark, sf_dir).items():
        d = df.select(F.lit(adapter).alias("adapter"), "row_id", P.question(adapter).alias("question"),
                      P.gold_label(adapter).alias("gold"))
        out = d if out is None else out.unionByName(d)
    return out


@register("p5_gold_label", f"SELECT item_id AS row_id, {BOX} AS gold FROM benchmark")
def p5_gold_label(spark, sf_dir):
    return FX.problems_dapo(spark, sf_dir).select("row_id", P.gold_label("dapo").alias("gold"))


SYS = O.lit(__import__("rolloutlens.config", fromlist=["SYSTEM_PROMPT"]).SYSTEM_PROMPT)


@register("p3_group_expansion", f"""SELECT item_id AS prompt_idx, CAST(g AS INTEGER) AS gen_idx, {SYS} AS sys_text
FROM benchmark, range(0, 12) AS t(g)""")
def p3_group_expansion(spark, sf_dir):
    """G = 12 prompts per problem, one per system text."""
    d = P.expand_group(FX.problems_test(spark, sf_dir), 12)
    return d.select(F.col("row_id").alias("prompt_idx"), F.col("gen_idx").cast("int"), "sys_text")


@register("p4_two_message_prompt", f"""SELECT item_id AS prompt_idx, CAST(g AS INTEGER) AS gen_idx, CAST(m AS INTEGER) AS msg,
       CASE WHEN m = 0 THEN 'system' ELSE 'user' END AS role, CASE WHEN m = 0 THEN {SYS} ELSE text END AS content
FROM benchmark, range(0, 12) AS t(g), range(0, 2) AS u(m)""")
def p4_two_message_prompt(spark, sf_dir):
    """P4 (+P2, P3): [system, user] lists in long form."""
    pr = P.build_prompts(FX.problems_test(spark, sf_dir), "test", "test", 12)
    x = pr.select("prompt_idx", "gen_idx", F.posexplode("messages").alias("msg", "m"))
    return x.select("prompt_idx", "gen_idx", F.col("msg").cast("int"), "m.role", "m.content")


def _prompts_and_completions(spark, sf_dir):
    pr = P.build_prompts(FX.problems_test(spark, sf_dir), "test", "test", 8)
    comp = FX.rollouts(spark, sf_dir).select("prompt_idx", "gen_idx", "content")
    return pr, comp


J1_SQL = f"""{O.ROLLOUTS},
pr AS (SELECT item_id AS prompt_idx, CAST(g AS INTEGER) AS gen_idx, text FROM benchmark, range(0, 8) AS t(g))"""


@register("p6_append_assistant_turn", f"""WITH {J1_SQL}
SELECT prompt_idx, gen_idx, 3 AS n_messages, content AS last_content
FROM pr JOIN rollouts USING (prompt_idx, gen_idx)""")
def p6_append_assistant_turn(spark, sf_dir):
    """J1 + P6 + P7: prompts joined with outputs, assistant turn appended."""
    pr, comp = _prompts_and_completions(spark, sf_dir)
    joined, _ = P.attach_completions(pr, comp)
    return joined.select("prompt_idx", "gen_idx", F.size("messages").alias("n_messages"),
                         TX.last_content(F.col("messages")).alias("last_content"))


@register("j1_missing_report", f"""WITH {J1_SQL}
SELECT prompt_idx, gen_idx, 'no_completion' AS issue FROM pr ANTI JOIN rollouts USING (prompt_idx, gen_idx)
UNION ALL
SELECT prompt_idx, gen_idx, 'no_prompt' AS issue FROM rollouts ANTI JOIN pr USING (prompt_idx, gen_idx)""")
def j1_missing_report(spark, sf_dir):
    """Anti-join report of prompts without output and outputs without prompt."""
    pr, comp = _prompts_and_completions(spark, sf_dir)
    return P.attach_completions(pr, comp)[1]


@register("j1_positional_pairs", f"""WITH {O.ROLLOUTS_EVENTS}
SELECT 'Problem ' || CAST(prompt_idx AS VARCHAR) AS question, gold, content FROM rollouts
WHERE prompt_idx < (SELECT max(prompt_idx) FROM rollouts) OR gen_idx < 3""")
def j1_positional_pairs(spark, sf_dir):
    """J1 + P6 without keys: a list of prompts and a shorter list of outputs,
    in files of different sizes, paired by place; the assistant turn appended."""
    r = FX.rollouts_events(spark, sf_dir)
    top = r.select(F.max("prompt_idx")).scalar()
    keys, prompts, outputs = ["prompt_idx", "gen_idx"], scratch_path(spark, "prompt-list"), scratch_path(spark, "output-list")
    messages = P.two_message_prompt(F.lit("Solve it."), F.concat(F.lit("Problem "), F.col("prompt_idx").cast("string")))
    r.repartitionByRange(*keys).sortWithinPartitions(*keys).select(messages.alias("messages"), "gold").write.parquet(prompts)
    some = r.where((F.col("prompt_idx") < top) | (F.col("gen_idx") < 3))
    some.repartitionByRange(7, *keys).sortWithinPartitions(*keys).select("content").write.parquet(outputs)
    pairs = P.pair_by_position(RD.read_positioned(spark, prompts), RD.read_positioned(spark, outputs))
    turns = pairs.select("gold", P.append_turn(F.col("messages"), F.col("content")).alias("messages"))
    return turns.select(F.col("messages")[1]["content"].alias("question"), "gold", F.col("messages")[2]["content"].alias("content"))


@register("p9_render_messages", f"""WITH {J1_SQL}
SELECT prompt_idx, gen_idx,
       '<|system|>' || chr(10) || {SYS} || chr(10) || '<|user|>' || chr(10) || text || chr(10)
       || '<|assistant|>' || chr(10) || content || chr(10) AS rendered
FROM pr JOIN rollouts USING (prompt_idx, gen_idx)""")
def p9_render_messages(spark, sf_dir):
    """P9 (re-aimed): message list rendered with role tags."""
    pr, comp = _prompts_and_completions(spark, sf_dir)
    joined, _ = P.attach_completions(pr, comp)
    return joined.select("prompt_idx", "gen_idx", TX.render_messages(F.col("messages")).alias("rendered"))


def _p8_sql() -> str:
    text = "(text || ' ha ha ha')"
    cases = []
    for n in range(1, 6):
        pat = f"('(' || regexp_escape(right({text}, {n})) || '){{3,}}$')"
        cases.append(f"WHEN regexp_matches({text}, {pat}) THEN regexp_replace({text}, {pat}, '')")
    return f"""SELECT doc_id, length(s) AS clean_len, md5(s) AS clean_md5
FROM (SELECT doc_id, CASE {' '.join(cases)} ELSE {text} END AS s FROM documents)"""


@register("p8_remove_stutter", _p8_sql())
def p8_remove_stutter(spark, sf_dir):
    """P8 over whole documents. RE2 has no back-references, so the oracle
    builds each pattern from the escaped last L characters."""
    d = FX.read_table(spark, sf_dir, "documents")
    s = TX.remove_stutter(F.concat(F.col("text"), F.lit(" ha ha ha")))
    d = d.select("doc_id", s.alias("s"))
    return d.select("doc_id", F.length("s").cast("long").alias("clean_len"), F.md5("s").alias("clean_md5"))


@register("j3_solution_join", f"""WITH {O.ROLLOUTS_EVENTS},
sol AS (SELECT prompt_idx, gen_idx, gold FROM rollouts WHERE gen_idx < 6)
SELECT r.prompt_idx, r.gen_idx, length(r.content) AS len, s.gold FROM rollouts r JOIN sol s USING (prompt_idx, gen_idx)""")
def j3_solution_join(spark, sf_dir):
    """Completion <-> per-row solution; rows without a partner drop out,
    as the shorter list wins in a positional zip."""
    r = FX.rollouts_events(spark, sf_dir)
    sol = r.filter(F.col("gen_idx") < 6).select("prompt_idx", "gen_idx", "gold")
    return (r.select("prompt_idx", "gen_idx", F.length("content").cast("long").alias("len"))
             .join(sol, ["prompt_idx", "gen_idx"], "inner"))


@register("j4_reward_vectors", f"""WITH {O.scored_ctes(O.ROLLOUTS_EVENTS)}
SELECT prompt_idx, gen_idx, acc, fmt, reward FROM scored""")
def j4_reward_vectors(spark, sf_dir):
    """Accuracy and format rewards are two columns of one row - no join."""
    from .catalog import event_scored
    return event_scored(spark, sf_dir).select("prompt_idx", "gen_idx", "acc", "fmt", "reward")


CASES_SQL = """cases AS (SELECT user_id AS completion_id, event_id AS case_id,
  CAST(event_type = 'error' AS INTEGER) AS returncode, ' ' || event_type || ' ' AS stdout,
  CASE WHEN event_id % 3 = 0 THEN 'click' ELSE event_type END AS expected FROM events)"""


@register("a11_code_pass_rate", f"""WITH {CASES_SQL}
SELECT completion_id, {O.r9("avg(CASE WHEN returncode = 0 AND trim(stdout) = trim(expected) THEN 1.0 ELSE 0.0 END)")}
       AS pass_rate, count(*) AS n_cases FROM cases GROUP BY completion_id""")
def a11_code_pass_rate(spark, sf_dir):
    d = R.code_pass_rate(FX.code_cases(spark, sf_dir))
    return d.select("completion_id", r9("pass_rate").alias("pass_rate"), "n_cases")


@register("j5_code_cases_join", f"""WITH {CASES_SQL},
comp AS (SELECT DISTINCT user_id AS completion_id FROM events WHERE event_type <> 'error')
SELECT completion_id, case_id, CAST(returncode = 0 AND trim(stdout) = trim(expected) AS INTEGER) AS passed
FROM comp JOIN cases USING (completion_id)""")
def j5_code_cases_join(spark, sf_dir):
    """Executed test cases of the completions that ran (a user with an
    event that is no error). A semi join of two plain scans: AQE splits a hot
    user's partition, and nobody is grouped first."""
    cases = FX.code_cases(spark, sf_dir)
    comp = FX.read_table(spark, sf_dir, "events").where(F.col("event_type") != "error") \
             .select(F.col("user_id").alias("completion_id"))
    passed = (F.col("returncode") == 0) & (F.trim("stdout") == F.trim("expected"))
    return cases.join(comp, "completion_id", "left_semi").select("completion_id", "case_id", passed.cast("int").alias("passed"))


@register("j5_snippet_cases", f"""WITH {O.ROLLOUTS},
code AS (SELECT prompt_idx, gen_idx, coalesce(regexp_extract_all(content, {O.lit(O.CODE_BLOCK)}, 1)[-1], '') AS code FROM rollouts),
cases AS (SELECT DISTINCT prompt_idx, unnest([0, 1, 2, 3]) AS case_id FROM rollouts)
SELECT prompt_idx, gen_idx, CAST(case_id AS INTEGER) AS case_id, code, 'print(' || CAST(case_id AS VARCHAR) || ')' AS expected,
       CAST(trim(code, chr(10)) = 'print(' || CAST(case_id AS VARCHAR) || ')' AS INTEGER) AS passed
FROM code JOIN cases USING (prompt_idx) WHERE code <> ''""")
def j5_snippet_cases(spark, sf_dir):
    """J5 from the arrays: every problem's ``test_cases`` exploded, joined to
    the snippet (A10) of every completion of the problem."""
    r = FX.rollouts(spark, sf_dir)
    code = r.select("prompt_idx", "gen_idx", TX.extract_code(F.col("content")).alias("code")).where("code <> ''")
    cases = P.exploded_cases(FX.problems_code(spark, sf_dir))
    passed = F.btrim("code", F.lit("\n")) == F.col("expected")
    return code.join(cases, "prompt_idx").select("prompt_idx", "gen_idx", "case_id", "code", "expected", passed.cast("int").alias("passed"))


@register("s4_s5_buffer_roundtrip", f"""WITH {KEPT_SQL}
SELECT prompt_idx, gen_idx, {O.r9('advantage')} AS advantage, reward, gold AS label, content FROM filled""")
def s4_s5_buffer_roundtrip(spark, sf_dir):
    """S4 -> S5: the budgeted buffer written as JSON lines into the shared
    checkpoint folder and read back with the declared schema."""
    return _roundtrip(spark, _filled(spark, sf_dir))


@register("s4_s5_kept_roundtrip", f"""WITH {KEPT_ALL_SQL}
SELECT prompt_idx, gen_idx, {O.r9('advantage')} AS advantage, reward, gold AS label, content FROM kept_all""")
def s4_s5_kept_roundtrip(spark, sf_dir):
    """S4 -> S5 over all kept rows, without a budget."""
    return _roundtrip(spark, _kept(spark, sf_dir))


def _roundtrip(spark, buf):
    rec = buf.select("prompt_idx", "gen_idx",
                     F.array(P.message("assistant", F.col("content"))).alias("completion"),
                     "advantage", "reward", F.col("gold").alias("label"))
    path = scratch_path(spark, "buffer")
    SK.write_buffer(rec, path)
    back = RD.read_buffer(spark, path)
    return back.select("prompt_idx", "gen_idx", r9("advantage").alias("advantage"), "reward", "label",
                       TX.last_content(F.col("completion")).alias("content"))


@register("s5_json_arrays", f"""WITH {KEPT_ALL_SQL}
SELECT prompt_idx, gen_idx, {O.r9('advantage')} AS advantage, reward, gold AS label, content FROM kept_all""")
def s5_json_arrays(spark, sf_dir):
    """S5 over all kept rows: buffers as the trainer leaves them, an indented
    JSON array a file, read in ranges of 64 KB."""
    from ..plans.scoring import to_buffer_records
    from ..sources.json_array import read_json_array
    path = scratch_path(spark, "array-buffers")
    FX.write_json_arrays(to_buffer_records(_kept(spark, sf_dir)), path)
    d = read_json_array(spark, path, schemas.BUFFER, 1 << 16)
    return d.select("prompt_idx", "gen_idx", r9("advantage").alias("advantage"), "reward", "label",
                    F.col("completion")[0]["content"].alias("content"))


@register("s6_buffer_head", f"""WITH {KEPT_SQL}
SELECT prompt_idx, gen_idx, position FROM filled ORDER BY position LIMIT 1""")
def s6_buffer_head(spark, sf_dir):
    """The first buffer record (a limit that is the feature)."""
    return _filled(spark, sf_dir).orderBy("position").limit(1).select("prompt_idx", "gen_idx", "position")
