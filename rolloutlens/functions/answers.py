"""Answer extraction and equivalence (A1, A2) as native column expressions.

The rule is a documented subset of symbolic answer matching:

1. extract the last balanced ``\\boxed{...}``, at any brace depth (one pass
   over the text's braces); for gold labels only, fall back to the last
   ``$...$``;
2. canonicalise with a fixed list of global replacements; a plain decimal of
   any length is brought to its normal form (no plus sign, no leading zeros,
   no trailing fraction zeros);
3. read the canonical text as an exact rational (num, den) in DECIMAL(19,0)
   when it is an integer, a decimal, ``a/b`` or ``\\frac{a}{b}``, signs allowed
   everywhere; the scale of a decimal is taken from its digits. Products of 19
   digits each fill the 38 that DECIMAL holds. A fraction with over 19 digits
   on a side, or a decimal with over 19 in all or 18 after the point, has no
   rational reading: it equals only its own canonical text (two such decimals still compare
   exactly, by normal form);
4. a value of values (a tuple, set, list or interval, nested to any depth, or
   several values with commas) gets one text for all its spellings: its parts
   are brought to normal form by the rules above, fractions in lowest terms,
   and the parts of a set ``\\{...\\}`` are sorted, repeats kept; the order in
   tuples, lists and intervals counts, as do their brackets;
5. two answers are equal iff both are numeric with n1*d2 = n2*d1, or their
   canonical strings are equal and non-empty. NULL never equals anything.

No algebra (``x+1`` vs ``1+x``), matrices or tolerance.
Every step is a JVM expression (no Python UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns of the answer rule (Java regex dialect) ---
DOLLAR = r"\$([^$]+)\$"
# ordered global replacements (pattern, replacement)
CANON_STEPS = (
    (r"\\\$|\$", ""),
    (r"\\left|\\right", ""),
    (r"\\[,;!]|\\ ", ""),
    (r"\\[dt]frac", r"\\frac"),
    (r"[ \t\n\x0B\f\r]+", ""),
    (r"^(.+?)\\(?:text|mathrm)\{[^{}]*\}\z", "$1"),
    (r"^\\(?:text|mathrm)\{([^{}]*)\}\z", "$1"),
    (r"\^\{?\\circ\}?", ""),
    (r"\\?%", ""),
    (r"^[A-Za-z]=", ""),
    (r"\.\z", ""),
)
THOUSANDS = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\z"
# normal form of a plain decimal: these replacements in order
PLAIN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)\z"
NORMAL_STEPS = (
    (r"^\+", ""),
    (r"^(-?)0+(?=[0-9])", "$1"),
    (r"^-\.", "-0."),
    (r"^\.", "0."),
    (r"(\.[0-9]*?)0+\z", "$1"),
    (r"\.\z", ""),
    (r"^-0\z", "0"),
)
FRAC = r"^([+-]?)\\frac\{([+-]?)([0-9]{1,19})\}\{([+-]?)([0-9]{1,19})\}\z"
SLASH = r"^([+-]?)()([0-9]{1,19})/([+-]?)([0-9]{1,19})\z"
DECIMAL = r"^(-?)([0-9]{1,19})(?:\.([0-9]{1,18}))?\z"
# a value of values, and its pieces: brackets, commas, and parts (with the braces of their commands)
NESTED = r"^(?:\\\{|[(\[]).*(?:\\\}|[)\]])\z|,"
PIECE = r"\\[{}]|[()\[\],]|(?:\\(?![{}])|\{(?:[^{}\\]|\\[^{}])*\}|[^()\[\],\\{}])+|[{}]"
# --- end of fixed values ---

_DEC = "decimal(19,0)"   # 19 digits max; products stay exact in decimal(38,0)


def _q(s: str) -> str:
    """A Spark SQL string literal holding ``s`` exactly."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_last(text: str, pattern: str) -> str:
    return f"try_element_at(regexp_extract_all({text}, {_q(pattern)}, 1), -1)"


def _sql_boxed(text: str) -> str:
    """Content of the last balanced box, any depth. The text is cut behind
    every brace; a fold over the pieces keeps the place, the depth and a stack
    of open boxes (where the content starts, the depth outside). The box that
    closes last is the last match: one around it would close later."""
    state = ("named_struct('pos', 0, 'depth', 0, 'open', CAST(array() AS array<struct<at:int,depth:int>>), "
             "'first', 0, 'last', -1)")
    step = r"""(a, t) -> CASE
      WHEN endswith(t, '{') THEN named_struct('pos', a.pos + length(t), 'depth', a.depth + 1,
        'open', CASE WHEN endswith(t, '\\boxed{')
                     THEN array_append(a.open, named_struct('at', a.pos + length(t) + 1, 'depth', a.depth)) ELSE a.open END,
        'first', a.first, 'last', a.last)
      WHEN size(a.open) > 0 AND try_element_at(a.open, -1).depth = a.depth - 1 THEN named_struct('pos', a.pos + length(t),
        'depth', a.depth - 1, 'open', slice(a.open, 1, size(a.open) - 1),
        'first', try_element_at(a.open, -1).at, 'last', a.pos + length(t) - 1)
      ELSE named_struct('pos', a.pos + length(t), 'depth', a.depth - 1, 'open', a.open, 'first', a.first, 'last', a.last) END"""
    pieces = f"regexp_extract_all({text}, '[^{{}}]*+[{{}}]', 0)"
    done = f"a -> CASE WHEN a.first > 0 THEN substring({text}, a.first, a.last - a.first + 1) END"
    return f"CASE WHEN contains({text}, '\\\\boxed{{') THEN aggregate({pieces}, {state}, {step}, {done}) END"


def _sql_steps(s: str, steps) -> str:
    for pat, rep in steps:
        s = f"regexp_replace({s}, {_q(pat)}, {_q(rep)})"
    return s


def _sql_canonical(raw: str) -> str:
    s = _sql_steps(raw, CANON_STEPS)
    return f"CASE WHEN {s} RLIKE {_q(THOUSANDS)} THEN regexp_replace({s}, ',', '') ELSE {s} END"


def _sql_normal(c: str) -> str:
    return f"nullif(CASE WHEN {c} RLIKE {_q(PLAIN)} THEN {_sql_steps(c, NORMAL_STEPS)} ELSE {c} END, '')"


def _sql_parsed(c: str) -> str:
    def g(p, i):
        return f"regexp_extract({c}, {_q(p)}, {i})"

    def signed(p):
        """Numerator digits under the product of the signs."""
        minus = " + ".join(f"CAST({g(p, i)} = '-' AS INT)" for i in (1, 2, 4))
        return f"try_cast(concat(CASE WHEN ({minus}) % 2 = 1 THEN '-' ELSE '' END, {g(p, 3)}) AS {_DEC})"
    dec = f"CAST(NULL AS {_DEC})"
    is_dec, is_frac, is_slash = (f"{c} RLIKE {_q(DECIMAL)}", f"{c} RLIKE {_q(FRAC)}", f"{c} RLIKE {_q(SLASH)}")
    num = (f"CASE WHEN {is_dec} THEN try_cast(concat({g(DECIMAL, 1)}, {g(DECIMAL, 2)}, {g(DECIMAL, 3)}) AS {_DEC}) "
           f"WHEN {is_frac} THEN {signed(FRAC)} WHEN {is_slash} THEN {signed(SLASH)} END")
    den = (f"CASE WHEN {is_dec} THEN try_cast(rpad('1', 1 + length({g(DECIMAL, 3)}), '0') AS {_DEC}) "
           f"WHEN {is_frac} THEN try_cast({g(FRAC, 5)} AS {_DEC}) "
           f"WHEN {is_slash} THEN try_cast({g(SLASH, 5)} AS {_DEC}) END")
    ok = f"(({den}) IS NOT NULL AND ({den}) <> 0)"
    return (f"named_struct('canon', {c}, 'num', CASE WHEN {ok} THEN {num} ELSE {dec} END, "
            f"'den', CASE WHEN {ok} THEN {den} ELSE {dec} END)")


def _sql_nested(c: str) -> str:
    """One text for all spellings of a value of values: a fold over its pieces
    with a stack of open brackets, each with its parts so far."""
    d = f"CAST({{}} AS {_DEC})"
    parsed = f"transform(transform(regexp_extract_all({c}, {_q(PIECE)}, 0), t -> {_sql_normal('t')}), n -> {_sql_parsed('n')})"
    # Euclid takes at most five steps for each digit of the smaller number (Lamé), and one to put it second
    steps = "sequence(1, 5 * length(CAST(p.den AS STRING)) + 1)"
    gcd = (f"CASE WHEN p.den = 1 THEN p.den ELSE aggregate({steps}, named_struct('a', {d.format('abs(p.num)')}, 'b', {d.format('p.den')}), "
           f"(s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', {d.format('s.a % s.b')}) END, s -> s.a) END")
    lowest = (f"transform({parsed}, p -> CASE WHEN p.num IS NULL THEN p.canon ELSE element_at(transform(array({gcd}), "
              f"g -> concat(CAST(CAST(p.num / g AS {_DEC}) AS STRING), CASE WHEN p.den = g THEN '' "
              f"ELSE concat('/', CAST(CAST(p.den / g AS {_DEC}) AS STRING)) END)), 1) END)")
    frame = "named_struct('open', {}, 'parts', CAST(array() AS array<string>))"
    top, rest = "element_at(s.stack, -1)", "slice(s.stack, 1, size(s.stack) - 1)"
    ended = f"array_append({top}.parts, s.cur)"
    sets = f"CASE WHEN {top}.open = {_q(chr(92) + '{')} THEN array_sort({ended}) ELSE {ended} END"
    state = "named_struct('stack', {}, 'cur', {})"
    step = f"""(s, t) -> CASE
      WHEN t IN ('(', '[', {_q(chr(92) + '{')}) AND s.cur = '' THEN {state.format(f"array_append(s.stack, {frame.format('t')})", "''")}
      WHEN t = ',' THEN {state.format(f"array_append({rest}, named_struct('open', {top}.open, 'parts', {ended}))", "''")}
      WHEN t IN (')', ']', {_q(chr(92) + '}')}) AND size(s.stack) > 1
        THEN {state.format(rest, f"concat({top}.open, array_join({sets}, ','), t)")}
      ELSE {state.format("s.stack", "concat(s.cur, t)")} END"""
    whole = f"s -> concat_ws('', transform(s.stack, (f, i) -> concat(f.open, array_join(CASE WHEN i = size(s.stack) - 1 THEN {ended} ELSE f.parts END, ','))))"
    return f"aggregate({lowest}, {state.format('array(' + frame.format(_q('')) + ')', _q(''))}, {step}, {whole})"


def with_parsed(df, text_col: str, out: str, gold: bool = False):
    """Add ``out`` = struct(canon, num, den) parsed from ``text_col``.

    Box, canonical text and normal form each get a column of their own before
    the next step refers to them several times, so no step runs twice. Every
    step is one SQL expression (one call to the JVM instead of hundreds of
    Column-builder calls).
    """
    t = f"`{text_col}`"
    raw = f"coalesce({_sql_boxed(t)}, {_sql_last(t, DOLLAR)})" if gold else _sql_boxed(t)
    box, canon, normal = f"_{out}_box", f"_{out}_canon", f"_{out}_normal"
    return (df.withColumn(box, F.expr(raw))
              .withColumn(canon, F.expr(_sql_canonical(f"`{box}`")))
              .withColumn(normal, F.expr(f"CASE WHEN `{canon}` RLIKE {_q(NESTED)} THEN {_sql_nested(f'`{canon}`')} ELSE {_sql_normal(f'`{canon}`')} END"))
              .withColumn(out, F.expr(_sql_parsed(f"`{normal}`")))
              .drop(box, canon, normal))


def answers_equal(a: Column, b: Column) -> Column:
    """A2: NULL-safe equivalence of two parsed answers -> boolean (never NULL)."""
    numeric = (a["num"].isNotNull() & b["num"].isNotNull()
               & ((a["num"] * b["den"]) == (b["num"] * a["den"])))
    same = a["canon"].isNotNull() & (a["canon"] == b["canon"])
    return F.coalesce(numeric | same, F.lit(False)) & a["canon"].isNotNull() & b["canon"].isNotNull()
