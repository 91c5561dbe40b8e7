"""BPE against the public library, text by text."""
import hashlib

import pytest
import tokenizers

from rolloutlens.llm import bpe as B
from rolloutlens.llm import common as C

from .conftest import EDGES

TEXTS = [t for _, t in EDGES] + [
    "Σοφός ΣΑΣ İstanbul ẞ é ﬁ ", "<|startoftext|>Hi<|endoftext|><|ENDOFTEXT|>", "a\x1cb \x1f c", "x" * 5000 + " " + "ab" * 300,
    "I'LL don't 'S ''s", "\x00\x01", "日本語漢字 한국어 العربية", "ǅ ǈ Ω Å", "a  b c d", "😀👍🏽 12,345.67", "hello hello hello"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(B.default_vocabulary())


def test_encode_and_decode_equal_the_library(library):
    codec = B.Codec(B.default_vocabulary())
    for t, (ids, decoded) in zip(TEXTS, codec.encode_all([t or "" for t in TEXTS])):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and codec.encode(t) == want, t
        assert decoded == library.decode(want, skip_special_tokens=False) == codec.decode(want)


def test_documents_equal_the_library(spark, library):
    docs = C.table(spark, "/root/testdata/sf0.01", "documents")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in B.query(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) == (
            len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_short_and_long_words_follow_one_rule():
    v = B.Vocabulary(B.default_vocabulary())
    for w in (b"unbelievable", b"a", "größe".encode(), b"ababababab" * 10, b"thethethe"):
        assert B.merge_words(v, [w])[0].tolist() == B.merge_long(v, w).tolist()


def test_cache_limit_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE", 2)
    codec = B.Codec(B.default_vocabulary())
    for t in TEXTS * 2:
        assert codec.encode_all([t or ""])[0][0] == " ".join(map(str, library.encode(t or "", add_special_tokens=False).ids))


def test_edge_rows_and_empty_table(documents):
    got = sorted(((r["doc_id"], len(r["ids"]), r["decoded"]) for r in B.encode(documents(EDGES)).collect()), key=str)
    codec = B.Codec(B.default_vocabulary())
    assert got == sorted(((i, len(codec.encode(t)), codec.decode(codec.encode(t))) for i, t in EDGES), key=str)
    assert B.encode(documents([])).count() == 0 and B.digests(documents([])).count() == 0
