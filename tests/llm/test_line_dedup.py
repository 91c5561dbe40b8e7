"""Line dedup against a plain loop over all lines."""
import hashlib
import random

from rolloutlens.llm import linededup as L

from .conftest import EDGES

LAST = float("inf")


def plain(rows, least=10):
    """(kept text, dropped) per row by the rule, with dictionaries."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    first, holders = {}, {}
    for i, t in rows:
        i = LAST if i is None else i
        for line in (t or "").split("\n"):
            k = key(line)
            first[k] = min(first.get(k, LAST), i)
            holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        i = LAST if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or first[key(x)] == i]
        out.append((None if i == LAST else i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    got = L.with_bitmaps(df).mapInArrow(L._digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string").collect()
    return sorted((tuple(r) for r in got), key=str)


def test_edge_rows(edges):
    assert found(edges) == plain(EDGES)


def test_random_lines_with_a_hot_line_over_many_partitions(documents, spark):
    rng = random.Random(4)
    pool = [f"shared line number {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice([*pool, "the hottest line of them all", "x", f"own line {i} {j}"]) for j in range(rng.randint(1, 20)))) for i in range(300)]
    rows += [(500 + i, "The HOTTEST line of them all\t") for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert found(documents(rows, parts=7)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_empty_table(documents):
    assert found(documents([])) == [] and L.keep_bitmaps(documents([])).count() == 0


def test_bitmaps_round_trip():
    text = "\n".join(map(str, range(40)))
    for gone in ([0], [39], [3, 17, 18], list(range(40))):
        kept, n = L.kept_lines(text, L._bitmap(gone))
        assert n == 40 and kept == [str(k) for k in range(40) if k not in gone]


def test_stage_keeps_columns_and_cuts_text(edges):
    got = L.drop_lines(edges, chars_col="n_chars")
    assert got.schema == edges.schema
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[5]["text"] == "other words follow here" and by_id[5]["n_chars"] == 23 and by_id[5]["doc"] == "clash"
    assert by_id[1]["text"] is None
