"""DuckDB oracle SQL: fixtures and answer rules in RE2 / DuckDB dialect.

The correctness gate runs each registered Spark query and an independent SQL
statement over the same parquet tables. This module holds the SQL side:
fixture CTEs (same rules as :mod:`rolloutlens.sources.fixtures`) and text
builders for the answer rule (same rule as
:mod:`rolloutlens.functions.answers`, written for RE2: no possessives, no
back-references). Equal results show that two dialects agree on the rule; the
rule itself is checked by rows written by hand in ``tests/test_answers.py``. DuckDB string literals keep backslashes as they are.
"""

from __future__ import annotations

# --- fixed values: the answer rule in RE2 syntax ---
DOLLAR = r"\$([^$]+)\$"
CANON_STEPS = (
    (r"\\\$|\$", ""),
    (r"\\left|\\right", ""),
    (r"\\[,;!]|\\ ", ""),
    (r"\\[dt]frac", r"\\frac"),
    (r"[ \t\n\x0B\f\r]+", ""),
    (r"^(.+?)\\(?:text|mathrm)\{[^{}]*\}\z", r"\1"),
    (r"^\\(?:text|mathrm)\{([^{}]*)\}\z", r"\1"),
    (r"\^\{?\\circ\}?", ""),
    (r"\\?%", ""),
    (r"^[A-Za-z]=", ""),
    (r"\.\z", ""),
)
THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\z"
PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"
FRAC = r"^([+-]?)\\frac\{([+-]?)([0-9]{1,19})\}\{([+-]?)([0-9]{1,19})\}\z"
SLASH = r"^([+-]?)()([0-9]{1,19})/([+-]?)([0-9]{1,19})\z"
DECIMAL = r"^(-?)([0-9]{1,19})(?:\.([0-9]{1,18}))?\z"
FORMAT = r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>\n?\z"
STEPS = r"(Step \p{Nd}+:|^\p{Nd}+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
CODE_BLOCK = r"(?s)```python\n(.*?)```"
CODE_FORMAT = r"(?s)\A<think>\n.*?\n</think>\n<answer>\n.*?```python.*?```.*?\n</answer>(?:\n|\z)"
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
DAPO_PREFIX = r"Solve.*?answer to the problem.\n\n"
DAPO_SUFFIX = r"\n\nRemember to put y.*? \"Answer:\"."
DAPO_HEAD = ("Solve the following math problem step by step. The last line of your response "
             "should be of the form Answer: $Answer (without quotes) where $Answer is the "
             "answer to the problem.\n\n")
DAPO_TAIL = '\n\nRemember to put your answer on its own line after "Answer:".'
# --- end of fixed values ---


BS = "\\"


def lit(s: str) -> str:
    """A DuckDB string literal (newlines through chr(10))."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")" if len(parts) > 1 else quoted[0]


def last_match(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, 1)[-1]"


def last_boxed(text: str) -> str:
    """Content of the last balanced box, any depth: a fold over the pieces
    that end with a brace (pos, depth, stack of open boxes, first, last)."""
    cell = "{'at': 0, 'depth': 0}"
    state = "'t': {t}, 'pos': {pos}, 'depth': {depth}, 'open': {open}, 'first': {first}, 'last': {last}"

    def st(**kw):
        return "{" + state.format(**kw) + "}"
    zero = dict(pos="0", depth="0", open=f"[{cell}][:0]", first="0", last="-1")
    keep = dict(t="''", pos="a.pos + length(x.t)", open="a.open", first="a.first", last="a.last")
    push = f"CASE WHEN ends_with(x.t, '{BS}boxed{{') THEN list_append(a.open, {{'at': a.pos + CAST(length(x.t) AS INTEGER) + 1, 'depth': a.depth}}) ELSE a.open END"
    keep["pos"] = "a.pos + CAST(length(x.t) AS INTEGER)"
    opened = st(**{**keep, "depth": "a.depth + 1", "open": push})
    closed = st(**{**keep, "depth": "a.depth - 1", "open": "a.open[:len(a.open) - 1]", "first": "a.open[-1].at",
                   "last": "a.pos + CAST(length(x.t) AS INTEGER) - 1"})
    stray = st(**{**keep, "depth": "a.depth - 1"})
    step = (f"CASE WHEN ends_with(x.t, '{{') THEN {opened} "
            f"WHEN len(a.open) > 0 AND a.open[-1].depth = a.depth - 1 THEN {closed} ELSE {stray} END")
    pieces = f"list_transform(regexp_extract_all({text}, '[^{{}}]*[{{}}]'), lambda brace_piece: {st(t='brace_piece', **zero)})"
    # the fold starts from a state, so a text without a brace gives that state
    fold = f"list_reduce({pieces}, lambda a, x: {step}, {st(t=chr(39) * 2, **zero)})"
    cut = f"list_transform([{fold}], lambda f: CASE WHEN f.first > 0 THEN substring({text}, f.first, f.last - f.first + 1) END)[1]"
    return f"CASE WHEN contains({text}, '{BS}boxed{{') THEN {cut} END"


def canon(x: str) -> str:
    s = x
    for pat, rep in CANON_STEPS:
        s = f"regexp_replace({s}, {lit(pat)}, {lit(rep)}, 'g')"
    return f"CASE WHEN regexp_matches({s}, {lit(THOUSANDS)}) THEN replace({s}, ',', '') ELSE {s} END"


def normal(c: str) -> str:
    """Normal form of a plain decimal, by its parts."""
    whole = f"coalesce(nullif(ltrim(regexp_extract({c}, '^[+-]?([0-9]*)', 1), '0'), ''), '0')"
    frac = f"rtrim(regexp_extract({c}, '[.]([0-9]*)$', 1), '0')"
    number = f"{whole} || CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END"
    sign = f"CASE WHEN starts_with({c}, '-') AND {number} <> '0' THEN '-' ELSE '' END"
    return f"nullif(CASE WHEN regexp_matches({c}, {lit(PLAIN)}) THEN {sign} || {number} ELSE {c} END, '')"


def num_den(c: str) -> tuple[str, str]:
    def g(p, i):
        return f"regexp_extract({c}, {lit(p)}, {i})"

    def signed(p):
        minus = " + ".join(f"CAST({g(p, i)} = '-' AS INTEGER)" for i in (1, 2, 4))
        return f"TRY_CAST(CASE WHEN ({minus}) % 2 = 1 THEN '-' ELSE '' END || {g(p, 3)} AS {dec})"

    dec = "DECIMAL(19,0)"  # products fill the 38 digits of a DECIMAL
    num = (f"CASE WHEN regexp_matches({c}, {lit(FRAC)}) THEN {signed(FRAC)} "
           f"WHEN regexp_matches({c}, {lit(SLASH)}) THEN {signed(SLASH)} "
           f"WHEN regexp_matches({c}, {lit(DECIMAL)}) THEN TRY_CAST({g(DECIMAL, 1)} || {g(DECIMAL, 2)} "
           f"|| {g(DECIMAL, 3)} AS {dec}) END")
    den = (f"CASE WHEN regexp_matches({c}, {lit(FRAC)}) THEN TRY_CAST({g(FRAC, 5)} AS {dec}) "
           f"WHEN regexp_matches({c}, {lit(SLASH)}) THEN TRY_CAST({g(SLASH, 5)} AS {dec}) "
           f"WHEN regexp_matches({c}, {lit(DECIMAL)}) THEN TRY_CAST(rpad('1', 1 + CAST(length({g(DECIMAL, 3)}) AS INTEGER), '0') AS {dec}) END")
    return num, den


def parsed_cols(text: str, prefix: str, gold: bool = False) -> str:
    """Select-list fragment: <prefix>_canon from ``text`` (one CTE level)."""
    raw = f"coalesce({last_boxed(text)}, {last_match(text, DOLLAR)})" if gold else last_boxed(text)
    # a list of one holds each step's value, so that the next may use it often
    step = f"list_transform([{raw}], lambda b: {canon('b')})"
    return f"list_transform({step}, lambda c: {normal('c')})[1] AS {prefix}_canon"


def numeric_cols(prefix: str) -> str:
    num, den = num_den(f"{prefix}_canon")
    ok = f"(({den}) IS NOT NULL AND ({den}) <> 0)"
    return (f"CASE WHEN {ok} THEN {num} END AS {prefix}_num, "
            f"CASE WHEN {ok} THEN {den} END AS {prefix}_den")


def equal(a: str, b: str) -> str:
    """NULL-safe equivalence of parsed answers with column prefixes a, b."""
    return (f"(coalesce(({a}_num IS NOT NULL AND {b}_num IS NOT NULL AND {a}_num * {b}_den = {b}_num * {a}_den)"
            f" OR ({a}_canon IS NOT NULL AND {a}_canon = {b}_canon), false)"
            f" AND {a}_canon IS NOT NULL AND {b}_canon IS NOT NULL)")


def r9(x: str) -> str:
    return f"(round({x}, 9) + 0.0)"


# -- fixtures ---------------------------------------------------------------

def _boxed(x: str) -> str:
    return f"('{BS}boxed{{' || {x} || '}}')"


ROLLOUTS = f"""rollouts AS (
  SELECT CAST(floor(doc_id / 8) AS BIGINT) AS prompt_idx,
         CAST(doc_id % 8 AS INTEGER) AS gen_idx,
         {_boxed("CAST(CAST(floor(doc_id / 8) AS BIGINT) % 4 AS VARCHAR)")} AS gold,
         CASE WHEN m <= 4 THEN pre || box || post
              WHEN m = 5 THEN pre || box || post || chr(10)
              WHEN m = 6 THEN body || ' ' || box
              WHEN m = 7 THEN pre || 'no final value' || post
              WHEN m = 8 THEN {lit("<think>" + chr(10) + "1. Plan." + chr(10) + "Step 2: compute." + chr(10)
                                    + "- note" + chr(10) + "* check" + chr(10) + "First, x. Next, y." + chr(10)
                                    + "</think>" + chr(10) + "<answer>" + chr(10) + "```python" + chr(10) + "print(")}
                              || a || {lit(")" + chr(10) + "```" + chr(10) + "Finally, ")} || box || post
              ELSE body || ' ' || box || ' ha ha ha ha' END AS content
  FROM (
    SELECT *, {lit("<think>" + chr(10))} || body || {lit(chr(10) + "</think>" + chr(10) + "<answer>" + chr(10))} AS pre,
           {lit(chr(10) + "</answer>")} AS post,
           'Answer: ' || {_boxed("ans")} AS box
    FROM (
      SELECT *, CASE WHEN doc_id % 5 = 0 THEN '{BS}frac{{' || CAST(CAST(a AS INTEGER) * 2 AS VARCHAR) || '}}{{2}}'
                     WHEN doc_id % 5 = 1 THEN a || '.0' ELSE a END AS ans
      FROM (
        SELECT doc_id, text AS body,
               CAST(CAST(doc_id * doc_id + floor(doc_id / 3) AS BIGINT) % 4 AS VARCHAR) AS a,
               (doc_id * 13) % 10 AS m
        FROM documents))))"""

ROLLOUTS_EVENTS = f"""rollouts AS (
  SELECT CAST(floor(event_id / 8) AS BIGINT) AS prompt_idx,
         CAST(event_id % 8 AS INTEGER) AS gen_idx,
         {_boxed("CAST(CAST(floor(event_id / 8) AS BIGINT) % 3 AS VARCHAR)")} AS gold,
         CASE WHEN event_type = 'error' THEN 'no answer'
              WHEN event_type = 'view' THEN {_boxed("ans")}
              ELSE {lit("<think>" + chr(10) + "work" + chr(10) + "</think>" + chr(10) + "<answer>" + chr(10))}
                   || {_boxed("ans")} || {lit(chr(10) + "</answer>")} END AS content
  FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR) AS ans FROM events))"""

def _wide_form(form: str, n: str) -> str:
    """Number ``n`` (up to 19 digits) written in one of eight forms; the last two are n / 1000."""
    forms = [f"CAST({n} AS VARCHAR)", f"'{BS}frac{{' || {n} || '}}{{1}}'", f"'-{BS}dfrac{{' || {n} || '}}{{-1}}'", f"{n} || '/1'",
             f"format('{{:,}}', {n})", f"{n} || '.0'", f"'{BS}frac{{' || {n} || '}}{{1000}}'",
             f"({n} // 1000) || '.' || lpad(CAST({n} % 1000 AS VARCHAR), 3, '0')"]
    return _boxed(f"CASE {form} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END")


#: Pairs of answers from the orders; the same rules as ``fixtures.wide_answers``.
WIDE_ANSWERS = f"""wide0 AS (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) * 100000000000 + o_orderkey AS n FROM orders),
wide1 AS (SELECT k, k % 8 AS fa, (k // 8) % 8 AS fb, n, n + CAST(k % 7 = 0 AS BIGINT) AS m FROM wide0),
rollouts AS (SELECT k AS prompt_idx, 0 AS gen_idx, {_wide_form("fa", "n")} AS content, {_wide_form("fb", "m")} AS gold FROM wide1)"""


def scored_ctes(rollouts_cte: str = ROLLOUTS, fmt_weight: float = 1.0, acc_weight: float = 1.0,
                src: str = "rollouts") -> str:
    """rollouts -> parsed (ans_*, gold_*) -> scored (correct, acc, fmt, reward)."""
    return f"""{rollouts_cte},
p1 AS (SELECT *, {parsed_cols("content", "ans")}, {parsed_cols("gold", "gold", gold=True)} FROM {src}),
parsed AS (SELECT *, {numeric_cols("ans")}, {numeric_cols("gold")} FROM p1),
scored AS (
  SELECT *, acc * CAST({acc_weight} AS DOUBLE) + fmt * CAST({fmt_weight} AS DOUBLE) AS reward
  FROM (SELECT *, CAST(correct AS DOUBLE) AS acc,
               CAST(CASE WHEN regexp_matches(content, {lit(FORMAT)}) THEN 1 ELSE 0 END AS DOUBLE) AS fmt
        FROM (SELECT *, (gold_canon IS NULL OR {equal("ans", "gold")}) AS correct FROM parsed)))"""


SEQUENCES = """e AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings),
lp AS (SELECT vec_id, list_transform(x, lambda v: -abs(v))[2:] AS lp FROM e),
nrows AS (SELECT count(*) AS n FROM embeddings),
sequences AS (
  SELECT e.vec_id AS seq_id, list_transform(e.x, lambda v: CAST(floor(abs(v) * 20) AS INTEGER)) AS input_ids,
         a.lp AS logp, b.lp AS old_logp, c.lp AS ref_logp, (e.label - 4.5) / 3.0 AS advantage
  FROM e JOIN lp a ON a.vec_id = e.vec_id
  LEFT JOIN lp b ON b.vec_id = (e.vec_id + 1) % (SELECT n FROM nrows)
  LEFT JOIN lp c ON c.vec_id = (e.vec_id + 2) % (SELECT n FROM nrows)),
mpos AS (SELECT *, list_position(list_reverse(input_ids), 4) AS p_a, list_position(input_ids, 5) AS p_e,
                len(input_ids) AS nl FROM sequences),
masks AS (
  SELECT *, list_transform(input_ids, lambda x, i: CASE WHEN p_a IS NOT NULL AND i > nl - p_a + 1 THEN 1 ELSE 0 END) AS prefix,
            list_transform(input_ids, lambda x, i: CASE WHEN p_e IS NULL OR i <= p_e THEN 1 ELSE 0 END) AS suffix
  FROM mpos),
lmask AS (SELECT *, CASE WHEN nl >= 2 THEN list_transform(prefix, lambda x, i: x * suffix[i])[2:] ELSE []::INTEGER[] END AS mask
          FROM masks)"""


def long_form(table: str, key: str, arr: str, out: str, extra: str = "") -> str:
    """One row per array element: (key, pos 0-based, value)."""
    return (f"SELECT {key}, unnest(range(0, len({arr}))) AS pos, unnest({arr}) AS {out}{extra} "
            f"FROM {table}")
