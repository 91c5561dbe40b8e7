"""Text column functions over completions and prompts.

All are built-in JVM expressions (regex, string and higher-order functions),
evaluated row by row inside whole-stage codegen. Java-regex notes:
``(?d)`` makes ``.`` stop only at ``\\n`` (as in Python), ``\\z`` is the true
end of input (Java ``$`` also accepts a final ``\\r`` / U+2028), and
``\\p{Nd}`` is Python's Unicode ``\\d``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# --- fixed values: patterns and tags of the reward rules ---
DAPO_PREFIX = r"(?d)Solve.*?answer to the problem.\n\n"
DAPO_SUFFIX = r"(?d)\n\nRemember to put y.*? \"Answer:\"."
FORMAT = r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>\n?\z"
TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")
STEPS = r"(Step \p{Nd}+:|^\p{Nd}+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
CODE_BLOCK = r"(?s)```python\n(.*?)```"
# Python str.split() whitespace: \t\n\x0b\x0c\r, \x1c-\x1f, space, \x85, \xa0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
PY_WHITESPACE = (r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                 r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
# --- end of fixed values ---

_REGEX_META = set("\\^$.|?*+()[]{}")


def regex_quote(s: str) -> str:
    """Escape a literal for both Java regex and RE2."""
    return "".join("\\" + ch if ch in _REGEX_META else ch for ch in s)


def last_content(messages: Column) -> Column:
    """Content of the last message (NULL for an empty list). ``get``
    returns NULL out of range under ANSI too."""
    return F.get(messages, F.size(messages) - 1)["content"]


def clean_dapo_question(text: Column) -> Column:
    """Drop the DAPO boilerplate sentences around the question."""
    return F.regexp_replace(F.regexp_replace(text, DAPO_PREFIX, ""), DAPO_SUFFIX, "")


def remove_stutter(text: Column, min_repeat: int = C.STUTTER_MIN_REPEAT,
                   max_len: int = C.STUTTER_MAX_LEN) -> Column:
    """For L = 1..max_len, if the last L characters repeat >= min_repeat
    times at the very end, delete the whole run and stop.

    The test looks at the last characters only (constant cost); the regex that
    strips the run goes over the whole text on hits alone."""
    out = text
    for length in range(max_len, 0, -1):
        tail = F.right(text, F.lit(length))
        hit = F.right(text, F.lit(length * min_repeat)) == F.repeat(tail, F.lit(min_repeat))
        out = F.when((F.length(text) >= length * min_repeat) & hit,
                     F.regexp_replace(text, r"(?s)(.{%d})\1{%d,}\z" % (length, min_repeat - 1), "")).otherwise(out)
    return out


def render_messages(messages: Column, add_generation_tag: bool = False) -> Column:
    """P9 (re-aimed): role-tagged text ``<|role|>\\ncontent\\n`` per message."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(
        F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n"))), "")
    return F.concat(body, F.lit("<|assistant|>\n")) if add_generation_tag else body


def format_reward(text: Column) -> Column:
    """A4: 1.0 iff the whole text is think block then answer block."""
    return F.when(text.rlike(FORMAT), 1.0).otherwise(0.0)


def count_occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal (as Python ``str.count``)."""
    return F.try_divide(F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))),
                        F.lit(len(needle))).cast("int")


def tag_count_reward(text: Column) -> Column:
    """A5: +0.25 for each tag that occurs exactly once."""
    parts = [F.when(count_occurrences(text, t) == 1, 0.25).otherwise(0.0) for t in TAGS]
    return parts[0] + parts[1] + parts[2] + parts[3]


def reasoning_steps_reward(text: Column) -> Column:
    """min(1, n/3) with n non-overlapping step markers."""
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(STEPS)) / F.lit(3.0))


def extract_code(text: Column) -> Column:
    """A10: body of the last fenced python block, else ''."""
    return F.coalesce(F.try_element_at(
        F.regexp_extract_all(text, F.lit(CODE_BLOCK), F.lit(1)), F.lit(-1)), F.lit(""))


def code_format_pattern(language: str = "python") -> str:
    lang = regex_quote(language)
    return (r"(?s)\A<think>\n.*?\n</think>\n<answer>\n.*?```" + lang
            + r".*?```.*?\n</answer>(?:\n|\z)")


def code_format_reward(text: Column, language: str = "python") -> Column:
    """A4 with a fenced block of ``language`` inside the answer; text may
    continue on later lines."""
    return F.when(text.rlike(code_format_pattern(language)), 1.0).otherwise(0.0)


def length_column(text: Column, kind="chars") -> Column:
    """P10's length: characters (default), whitespace words, or a user
    tokenizer ``fn(str) -> list`` run as a vectorised pandas UDF."""
    if kind == "chars":
        return F.length(text)
    if kind == "words":
        return F.size(words(text))
    if callable(kind):
        fn = kind

        @F.pandas_udf("int")
        def n_tokens(s):
            return s.map(lambda t: None if t is None else len(fn(t))).astype("Int32")

        return n_tokens(text)
    raise ValueError(f"unknown length kind {kind!r}")


def words(text: Column) -> Column:
    """Lower-cased whitespace words (Python ``text.lower().split()``)."""
    return F.filter(F.split(F.lower(text), PY_WHITESPACE), lambda w: w != "")


def repetition_penalty(text: Column, ngram_size: int = 3, max_penalty: float = -1.0) -> Column:
    """(1 - distinct/total) * max_penalty over word n-grams; 0.0 for empty
    text or fewer than n words.

    Work is linear in the text: n-grams are joined into strings (words hold no
    whitespace, so the join is injective) and ``array_distinct`` on strings
    uses a hash set. The document stays one row: no shuffle.
    """
    if max_penalty > 0:
        raise ValueError(f"a penalty must be zero or negative, got {max_penalty}")

    def score(w: Column) -> Column:
        total = F.size(w) - F.lit(ngram_size - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(total, F.lit(1))),
                            lambda i: F.array_join(F.slice(w, i, ngram_size), " "))
        distinct = F.size(F.array_distinct(grams))
        rep = (F.lit(1.0) - distinct / total) * F.lit(float(max_penalty)) + F.lit(0.0)
        return F.when((text == "") | (F.size(w) < ngram_size), 0.0).otherwise(rep)

    return let(words(text), score)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Catalyst would otherwise copy a referenced expression into every use -
    inside an n-gram lambda that re-splits the text once per n-gram.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
