"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic
function of its words; the document's is their noisy-or, so that labels of
documents train the sentence scores, which then locate the sentences. Features
are words and their beginnings (for languages that inflect), hashed to 64 bits;
the model keeps those that occur in MIN_DOCS training documents and whose
occurrence depends on the label (SCREEN standard errors). It is fitted on at
most SAMPLE labelled rows (those with the least hash of doc_id), a bounded
sample, which also bounds its features; every document is scored.

Defined results: null and empty texts have no sentences and get the score 0; words are lower-cased (A-Z) and stripped of ASCII
punctuation; repeated rows are scored each; of several texts with one doc_id the least is learned from, with the
largest label; without usable labels every score is 0; an empty table gives no rows; doc_id, lang, source and labels are never features.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import signed, stored
from quarrylake.llm.suffix_tree_lm import fold_of

#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 6000
MIN_DOCS, SCREEN = 4, 4.0
#: Lengths in bytes of the beginnings of a word that are features.
BEGINNINGS = (3, 4, 5, 6)
STEPS, RATE, PENALTY = 150, 0.1, 1e-4
#: Sentences longer than this are scored in parts.
LONGEST = 64
THRESHOLD = 0.3
_ENDS = re.compile(rb"[.!?\n]+(?=\s|$)|\n+")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def sentences(text: str | None) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence with words, in UTF-8 bytes; long ones in parts of LONGEST words."""
    b, out, at = (text or "").encode(), [], 0
    for end in [*(m.end() for m in _ENDS.finditer(b)), len(b)]:
        words = [m for m in _WORD.finditer(b, at, end)]
        for k in range(0, len(words), LONGEST):
            part = words[k:k + LONGEST]
            out.append((part[0].start(), part[-1].end(), [m.group().lower() for m in part]))
        at = end
    return out


def features(word: bytes) -> list[int]:
    """64-bit hashes, the same in every process, of a word and of its beginnings."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(word), *(xxhash.xxh3_64_intdigest(b"^" + word[:k]) for k in BEGINNINGS if len(word) >= k)]


class Cached(dict):
    """Features of words seen before, or those of them that are kept; emptied when it grows large."""

    def __init__(self, kept: np.ndarray | None = None):
        self.kept = None if kept is None else set(kept.tolist())

    def __missing__(self, word: bytes) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        found = features(word) if self.kept is None else [f for f in features(word) if f in self.kept]
        self[word] = found = np.array(found, np.uint64)
        return found


def _seen(batches):
    """(feature, label, documents) of labelled texts."""
    schema = pa.schema([("f", pa.int64()), ("y", pa.int32()), ("n", pa.int64())])
    known = Cached()
    for batch in batches:
        y, held = batch.column("y").to_pylist(), ([], [])
        for k, text in enumerate(batch.column("text").to_pylist()):
            words = {w for _, _, ws in sentences(text) for w in ws}
            if words:
                held[y[k]].append(np.unique(np.concatenate([known[w] for w in words])))
        for label in (0, 1):
            if held[label]:
                f, n = np.unique(np.concatenate(held[label]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(f)), pa.array(np.full(len(f), label, np.int32)), pa.array(n.astype(np.int64))], schema=schema)


def _bags(kept):
    schema = pa.schema([("y", pa.int32()), ("sizes", pa.binary()), ("words", pa.binary())])

    def run(batches):
        """(y, kept features in each sentence, their places among the kept ones) of each labelled text, 4 bytes a number."""
        names = kept.value
        known = Cached(names)
        for batch in batches:
            sizes, words = [], []
            for text in batch.column("text").to_pylist():
                s = [np.concatenate([known[w] for w in set(ws)]) for _, _, ws in sentences(text)]
                sizes.append(np.array([len(f) for f in s], np.int32).tobytes())
                words.append(np.searchsorted(names, np.concatenate([*s, np.empty(0, np.uint64)])).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sizes, pa.binary()), pa.array(words, pa.binary())], schema=schema)

    return run, "y int, sizes binary, words binary"


class Model:
    """Feature weights of the sentence classifier, and its constant."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, bias: float):
        self.parts = names, weights, bias  # what workers get
        self.table = {int(w): float(x) for w, x in zip(names, weights) if x}
        self.bias = bias
        self.words: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        x = self.words.get(w)
        if x is None:
            if len(self.words) > 1_000_000:
                self.words.clear()
            x = self.words[w] = sum(self.table.get(f, 0.0) for f in features(w)) if self.table else 0.0
        return x

    def sentence(self, words: list[bytes]) -> float:
        z = self.bias + sum(self.word(w) for w in set(words))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def document(self, p: list[float]) -> float:
        return 1 - math.prod(1 - x for x in p)


def fit(names: np.ndarray, y: np.ndarray, sizes: list, words: list) -> Model:
    """Maximum likelihood of the noisy-or of logistic sentence scores, by Adam on all rows, with a penalty on weights.

    sizes: of each row's sentences, how many of its words (places in names) are theirs.
    """
    if not len(y) or not y.any():
        return Model(np.empty(0, np.uint64), np.empty(0), -30.0)
    bags = np.repeat(np.arange(len(y), dtype=np.int32), [len(s) for s in sizes])
    n, col = np.concatenate(sizes), np.concatenate(words)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    w = np.zeros(len(names))
    b = float(np.log(y.mean() / max(1.0, len(n) / len(y))))
    m1 = m2 = np.zeros(len(w) + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(owner, w[col], len(n)), -30, 30)))
        none = np.exp(np.bincount(bags, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)))
        # d loss / d z: p for clean documents, -p (1 - P) / P for toxic ones
        g = p * np.where(y[bags] == 1, -(none / np.clip(1 - none, 1e-9, 1))[bags], 1.0) / len(y)
        grad = np.append(np.bincount(col, g[owner], len(w)) + PENALTY * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad ** 2
        step = RATE * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return Model(names, w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> Model:
    """The model from labels (doc_id, toxic) outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & (fold_of(F.col("doc_id"), folds) != held))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    some = known.join(docs.select("doc_id").distinct(), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(stored(some)), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = stored(rows.select("y", "text"))
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    seen = rows.mapInArrow(_seen, "f long, y int, n long").groupBy("f").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("t"))
    # the difference of a feature's share in toxic and in other texts, in standard errors
    share = F.col("n") / n
    z = (F.col("t") / max(toxic, 1) - (F.col("n") - F.col("t")) / max(n - toxic, 1)) / F.sqrt(share * (1 - share) * (1 / max(toxic, 1) + 1 / max(n - toxic, 1)))
    kept = seen.where((F.col("n") >= MIN_DOCS) & (F.col("n") < n) & (F.abs(z) >= SCREEN)).select("f").toArrow()
    names = np.sort(kept.column("f").to_numpy().view(np.uint64))
    run, schema = _bags(docs.sparkSession.sparkContext.broadcast(names))
    bags = rows.mapInArrow(run, schema).toArrow()
    return fit(names, bags.column("y").to_numpy(), *([np.frombuffer(x.as_buffer(), np.int32) for x in bags.column(c)] for c in ("sizes", "words")))


def _scores(parts):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("worst", pa.string()), ("worst_score", pa.float64())])

    def run(batches):
        m = Model(*parts.value)
        for batch in batches:
            scores, texts, tops = [], [], []
            for text in batch.column("text").to_pylist():
                s = sentences(text)
                p = [m.sentence(w) for _, _, w in s]
                scores.append(m.document(p))
                k = int(np.argmax(p)) if p else -1
                texts.append((text or "").encode()[s[k][0]:s[k][1]].decode() if p else None)
                tops.append(p[k] if p else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(texts, pa.string()), pa.array(tops, pa.float64())], schema=schema)

    return run, "doc_id long, score double, worst string, worst_score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, worst, worst_score): the document's probability, its most offending sentence and that one's."""
    run, schema = _scores(docs.sparkSession.sparkContext.broadcast(model.parts))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model, limit: float) -> DataFrame:
    """The rows of docs, all columns, that score below the limit."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model.parts), docs.columns
    at = names.index("text")

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            mask = [m.document([m.sentence(w) for _, _, w in sentences(x)]) < limit for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    s = score(docs, train(docs, labels))
    return s.select("doc_id", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst")
