"""Toxicity scores from gradient-boosted trees over dense features.

Fit (bounded sample of labelled rows, split into three parts by a hash):
 A  learns the lexicon: words and word beginnings that toxic documents hold
    far more often than others, counted per document on the executors;
 B  fits the trees on the dense features below;
 C  fits the isotonic map from the trees' margin to a probability.
Parts keep each step honest: features on B and C come from a lexicon that
never saw those rows.

Features: lexicon densities, counts and strengths; distance of lexicon words
from second-person words; capitals, digits, exclamation and other punctuation,
non-ASCII bytes; obfuscation (letters mixed with digits or symbols, lexicon
words behind such spelling, letter runs, spaced single letters); length.

Defined results: null and empty texts are scored as the empty text (all
features 0). Without both classes among the labels every score is the base
rate. Repeated rows get equal scores; ties and extra columns play no part.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows per class that are fitted on (the fit's bound).
SAMPLE_ROWS = 4000
#: A lexicon entry is in at least this share of the toxic rows of part A,
MIN_SHARE = 0.015
MIN_ROWS = 3
#: and that much likelier there than elsewhere (log ratio).
MIN_LOG_ODDS = 2.0
MAX_LEXICON = 2000
#: Lengths of word beginnings that are counted beside whole words; the word itself is longer.
STEMS = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Words around a lexicon word that are searched for a second person.
NEAR = 5

SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes "
    "vous votre vos usted ustedes tú ti tus vosotros os".split())

WORD = re.compile(r"\w+")
MIXED = re.compile(r"[^\W\d_]+[0-9@$!*|]+[^\W\d_][\w@$!*|]*")
PLAIN = str.maketrans("013457@$!|", "oieastasil", "*_")

FEATURES = ["hits_log", "hit_density", "strong_density", "best_odds", "mean_odds", "distinct_log", "stem_density",
            "near_second", "second_density", "upper", "digit", "exclaim", "symbol", "punct", "non_ascii",
            "mixed_density", "mixed_hits", "runs", "single_run", "length_log"]


# ---- features -------------------------------------------------------------------------------------------------------

class Features:
    def __init__(self, lexicon: dict[str, float]):
        """lexicon: ``w:word`` or ``s:stem`` to log odds."""
        self.words = {k[2:]: v for k, v in lexicon.items() if k[0] == "w"}
        self.stems = {k[2:]: v for k, v in lexicon.items() if k[0] == "s"}
        n = min(STEMS)
        self.heads = frozenset(w[:n] for w in self.words) | frozenset(s[:n] for s in self.stems)

    def odds(self, word: str) -> tuple[float, bool]:
        """Strength of a word and whether the whole word is listed."""
        if word in self.words:
            return self.words[word], True
        return max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0), False

    def of(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        low = text.lower()
        words = WORD.findall(low)
        n = max(1, len(words))
        heads, k = self.heads, min(STEMS)
        at = [i for i, w in enumerate(words) if w[:k] in heads]
        hits = [(i, *o) for i, o in ((i, self.odds(words[i])) for i in at) if o[0] > 0]
        found = [o for _, o, _ in hits]
        near = sum(1 for i, _, _ in hits if not SECOND_PERSON.isdisjoint(words[max(0, i - NEAR):i + NEAR + 1]))
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        c = np.bincount(raw, minlength=256)
        size = len(raw)
        punct = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum())
        symbols = int(c[[35, 36, 37, 38, 42, 64, 94, 126]].sum())
        mixed = MIXED.findall(low) if c[48:58].any() or symbols or c[33] or c[124] else []
        spoken = sum(1 for m in mixed if self.odds(m.rstrip("!*|").translate(PLAIN))[0] > 0)
        runs = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 64)).sum()) if size > 2 else 0
        single = np.fromiter((len(w) == 1 for w in words), bool, len(words))
        spaced = int((single[2:] & single[1:-1] & single[:-2]).sum()) if len(words) > 2 else 0
        return [math.log1p(len(hits)), len(hits) / n, sum(1 for o in found if o > 4) / n, max(found, default=0.0),
                sum(found) / len(found) if found else 0.0, math.log1p(len({words[i] for i, _, _ in hits})),
                sum(1 for _, _, whole in hits if not whole) / n, near / max(1, len(hits)),
                sum(w in SECOND_PERSON for w in words) / n, int(c[65:91].sum()) / size, int(c[48:58].sum()) / size,
                int(c[33]) / size, symbols / size, punct / size, int(c[128:].sum()) / size, len(mixed) / n, spoken / n,
                runs / size, spaced / n, math.log1p(size)]


# ---- lexicon --------------------------------------------------------------------------------------------------------

def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term and class, summed inside the task before any shuffle."""
    pos: Counter = Counter()
    rest: Counter = Counter()

    def out():
        terms = list(pos.keys() | rest.keys())
        got = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()),
                                          pa.array([rest[t] for t in terms], pa.int64())], ["term", "pos", "neg"])
        pos.clear()
        rest.clear()
        return got

    for b in C.sliced(batches):
        for t, y in zip(C.texts(b, "text"), b.column("y").to_pylist()):
            words = set(WORD.findall(t.lower()))
            terms = {"w:" + w for w in words if len(w) > 2} | {f"s:{w[:n]}" for w in words for n in STEMS if len(w) > n}
            (pos if y else rest).update(terms)
        if len(pos) + len(rest) > 500_000:
            yield out()
    yield out()


def lexicon(part: DataFrame) -> dict[str, float]:
    """Terms of toxic rows with their log odds; part has text and y."""
    n = {r["y"]: r["n"] for r in part.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos or not neg:
        return {}
    odds = F.log((F.col("pos") + 0.5) / F.lit(pos + 1.0)) - F.log((F.col("neg") + 2.0) / F.lit(neg + 4.0))
    top = (part.select("text", "y").mapInArrow(_term_counts, "term string, pos long, neg long")
           .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
           .where(F.col("pos") >= max(MIN_ROWS, math.ceil(MIN_SHARE * pos))).withColumn("odds", odds)
           .where(F.col("odds") >= MIN_LOG_ODDS)
           .orderBy((F.col("odds") * F.col("pos")).desc(), "term").limit(MAX_LEXICON).collect())
    return {r["term"]: r["odds"] for r in top}


# ---- trees ----------------------------------------------------------------------------------------------------------

def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32,
              ridge: float = 2.0) -> dict:
    """Second-order boosting on the log loss with quantile bins. A tree is a
    complete binary tree: per inner node a feature and a cut (x > cut goes
    right), per leaf a weight."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)  # bin b: x <= cuts[b]
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin, model = np.full(len(y), base), {"base": base, "trees": []}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), int)
        feats, at = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            gain_best = np.full(count, 1e-6)
            local = node - first
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                width = len(cuts[f]) + 1
                cell = local * width + binned[:, f]
                gs = np.bincount(cell, g, count * width).reshape(count, width)
                hs = np.bincount(cell, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                best = gain.argmax(1)
                for k in range(count):
                    if gain[k, best[k]] > gain_best[k]:
                        gain_best[k], feats[first + k], at[first + k] = gain[k, best[k]], f, cuts[f][best[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feats[node]] > at[node])
        leaf = node - (2**depth - 1)
        weight = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge) * rate
        margin = margin + weight[leaf]
        model["trees"].append((feats, at, weight))
    return model


def tree_margin(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    for feats, at, weight in model["trees"]:
        node = np.zeros(len(x), int)
        while len(node) and node[0] < len(feats):  # complete trees: all rows reach the leaves together
            node = 2 * node + 1 + (x[rows, feats[node]] > at[node])
        out += weight[node - len(feats)]
    return out


def fit_isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (margin, probability). Equal margins are
    one block from the start. Half a pseudo row keeps blocks off 0 and 1."""
    order = np.argsort(margin, kind="stable")
    xs, start = np.unique(margin[order], return_index=True)
    sums, sizes = np.add.reduceat((y * weight)[order], start), np.add.reduceat(weight[order].astype(float), start)
    blocks: list[list[float]] = []  # sum, size, first x, last x
    for x, s, n in zip(xs, sums, sizes):
        blocks.append([s, n, x, x])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, n2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + n2, blocks[-1][2], last]
    knots = [(x, min(max(s / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1))) for s, n, a, b in blocks for x in ([a] if a == b else [a, b])]
    return np.array([k[0] for k in knots]), np.maximum.accumulate(np.array([k[1] for k in knots]))


# ---- fit and score --------------------------------------------------------------------------------------------------

def _feature_batches(lex: dict[str, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Features(lex)
    for b in C.sliced(batches):
        x = [f.of(t) for t in C.texts(b, "text")]
        yield pa.RecordBatch.from_arrays([b.column("part"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["part", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> dict:
    """labels: id and 0/1 label of the rows that may be learned from. All of
    them are counted; about ``sample_rows`` ids of each class at most, picked
    by a hash of the id, meet their texts through a broadcast of the picked
    ids (the bound holds at any size), are written once and fitted on."""
    y = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    model = {"lexicon": {}, "trees": None, "rate": counts.get(1, 0) / total if total else 0.0}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return model
    share = {k: min(1.0, sample_rows / n) for k, n in counts.items()}
    picked = y.where(C.unit_hash(F.col("i"), salt="toxicity") < F.when(F.col("y") == 1, share[1]).otherwise(share[0]))
    texts = docs.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    part = F.floor(C.unit_hash(F.col("text"), salt="parts") * 10).cast("int")
    sample = C.written(texts.join(F.broadcast(picked), "i").select("text", "y", part.alias("part")), "toxicity-sample")
    one_copy = sample.where("part < 5").groupBy("text").agg(F.max("y").alias("y"))
    model["lexicon"] = lexicon(one_copy)
    rows = sample.where("part >= 5").mapInArrow(functools.partial(_feature_batches, model["lexicon"]),
                                                "part int, y int, x array<double>").toArrow()
    part, y = (np.asarray(rows.column(c).to_pylist(), int) for c in ("part", "y"))
    x = np.asarray(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, y, part))  # the fit does not depend on the order in which tasks end
    part, y, x = part[order], y[order], x[order]
    b, c = part < 8, part >= 8
    if len(set(y[b])) < 2 or len(set(y[c])) < 2:  # too few rows to split
        b = c = np.ones(len(y), bool)
    if len(set(y[b])) < 2:
        return model
    model["trees"] = fit_trees(x[b], y[b])
    # the sample holds the classes at other shares than the labels: weigh back
    weight = np.where(y[c] == 1, 1 / share[1], 1 / share[0])
    model["knots"] = fit_isotonic(tree_margin(model["trees"], x[c]), y[c], weight)
    return model


class Scorer:
    def __init__(self, model: dict):
        self.model, self.features = model, Features(model["lexicon"])

    def score(self, batch: list[str]) -> np.ndarray:
        if self.model["trees"] is None:
            return np.full(len(batch), self.model["rate"])
        margin = tree_margin(self.model["trees"], np.array([self.features.of(t) for t in batch]).reshape(len(batch), -1))
        p = np.interp(margin, *self.model["knots"])
        return np.clip(0.999 * p + 0.001 / (1 + np.exp(-margin)), 0, 1)  # the last term orders rows of one block


def _score_batches(model: dict, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Scorer(model)
    for b in C.sliced(batches):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.score(C.texts(b, "text")), pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted per input row: one pass over the scan."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(functools.partial(_score_batches, model), "doc_id long, score double") \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _keep_batches(model: dict, text_col: str, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Scorer(model)
    for b in C.sliced(batches):
        clean = (s.score(C.texts(b, text_col)) < threshold) | b.column(text_col).is_null().to_numpy(zero_copy_only=False)
        yield b.filter(pa.array(clean, pa.bool_()))


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns without the documents scored as toxic. A
    null text holds nothing toxic and stays, whatever the score of the empty text."""
    return docs.mapInArrow(functools.partial(_keep_batches, model, text_col, threshold), docs.schema)


def learn_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: the fold of the id is not 1 of 3."""
    return labels.where(C.fold(id_col, 3) != 1)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    model = fit(docs, learn_rows(C.table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", F.coalesce(C.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
                                     "score", "predicted")
