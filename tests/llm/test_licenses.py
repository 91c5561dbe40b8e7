"""License scans against shingle sets of whole texts."""
import random

import pytest

from rolloutlens.llm import common as C
from rolloutlens.llm import licenses as L

from .conftest import EDGES


@pytest.fixture(scope="module")
def templates():
    return L.Templates(L.NOTICES)


def plain(templates, text, least=L.CONTAINMENT):
    """Templates whose shingles the whole text holds."""
    own = set(L.shingles(text).tolist())
    return {n for n, s in zip(templates.names, templates.sets) if len(own & set(s.tolist())) / len(s) >= least}


def test_band_settings_meet_nearly_always():
    assert L.collision_probability() > 0.999998 and L.collision_probability(1.0) > 0.9999999


@pytest.mark.parametrize("name", sorted(L.NOTICES))
def test_every_notice_is_found_anywhere(templates, name):
    rng = random.Random(name)
    for lead in (0, 1, 7, 300, 2001):
        text = " ".join(f"w{rng.randint(0, 999)}" for _ in range(lead)) + "\n" + L.NOTICES[name].upper() + "\n" + "tail words " * 30
        hits = {h[0]: h for h in L.scan(templates, text)}
        assert name in hits and hits[name][1] == 1.0 and hits[name][2] == lead and set(hits) == plain(templates, text)


def test_changed_words_lower_the_containment(templates):
    words = L.NOTICES["GPL"].split()
    one = words[:20] + ["changed"] + words[21:]
    assert "GPL" in {h[0] for h in L.scan(templates, " ".join(one))}
    many = [w if k % 8 else "changed" for k, w in enumerate(words)]
    assert "GPL" not in {h[0] for h in L.scan(templates, " ".join(many))}


def test_document_table_equals_whole_text_sets(spark, templates):
    rows = C.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()
    got = {(r["doc_id"], r["license"]) for r in L.query(spark, "/root/testdata/sf0.01").collect()}
    assert got == {(r["doc_id"], n) for r in rows for n in plain(templates, r["text"])} and got


def test_edge_rows_and_empty_table(documents):
    line = "Released under the MIT License."
    got = sorted(map(tuple, L.scan_documents(documents([*EDGES, (50, line), (50, line), (None, line)])).collect()), key=str)
    assert got == sorted([(50, "MIT-line", 1.0, 0, 5), (50, "MIT-line", 1.0, 0, 5), (None, "MIT-line", 1.0, 0, 5)], key=str)
    assert L.scan_documents(documents([])).count() == 0
