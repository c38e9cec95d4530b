"""Toxicity by multiple-instance learning.

Only documents are labelled. A document is toxic if any of its sentences is: sentence scores p_i are combined
by noisy-or, 1 - prod(1 - p_i), and the sentence scorer (a logistic model of its words) is trained through that
combination from the documents' labels. Sentences whose own score is high are then the offending ones.

Cases: null and empty texts have score 0 and no offending sentence; with no labelled row every score is 0;
labels that repeat for a document count once, 1 before 0; a null doc_id is never learned from and not held out; of
documents with the same doc_id each is learned from, up to 4 max_rows documents in all, the first by their ids' hash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.langid import held_out
from corroborate.session import ship

SPAN = "struct<start:int,end:int,p:double>"
RESULT = f"struct<score:double,n_sentences:int,offending:array<{SPAN}>>"


@dataclass(frozen=True)
class Params:
    """max_rows bounds the labelled documents that training reads, half of them toxic where there are so many."""

    max_rows: int = 6000
    vocabulary: int = 4000
    least_docs: int = 3
    least_errors: float = 4.0
    steps: int = 200
    rate: float = 0.15
    decay: float = 2e-4
    sentence_at: float = 0.5
    seed: int = 11


@dataclass
class Model:
    bias: float
    weights: dict[bytes, float]
    sentence_at: float


@lru_cache(1)
def _folded() -> bytes:
    """Sentence ends become newlines, other ASCII signs spaces, bytes of longer characters stay."""
    return bytes(b if b >= 128 or chr(b).isalnum() else 10 if chr(b) in ".!?\n\r" else 32 for b in range(256))


def sentences(text: str) -> list[bytes]:
    """Lower-cased pieces of the text; piece i+1 begins one byte after piece i ends."""
    return text.lower().encode().translate(_folded()).split(b"\n")


@dataclass
class Bags:
    """Labelled documents as bags of sentences. Sentences without a known word share one logit, the bias: they count by number."""

    y: np.ndarray
    plain: np.ndarray  # by document, its sentences without a known word
    doc_of: np.ndarray  # by other sentence
    sent_of: np.ndarray  # by known word of a sentence
    word_of: np.ndarray

    @classmethod
    def of(cls, bags: list[list[list[bytes]]], index: dict[bytes, int], y: np.ndarray) -> Bags:
        plain, doc_of, sent_of, word_of = np.zeros(len(y)), [], [], []
        for d, b in enumerate(bags):
            for s in b:
                known = sorted({index[w] for w in s if w in index})
                if known:
                    sent_of += [len(doc_of)] * len(known)
                    word_of += known
                    doc_of.append(d)
                else:
                    plain[d] += 1
        return cls(y, plain, np.array(doc_of, int), np.array(sent_of, int), np.array(word_of, int))

    def loss(self, w: np.ndarray, bias: float) -> tuple[float, np.ndarray, float]:
        """Cross-entropy of the documents' noisy-or, the two classes weighing the same, and its gradients by the words' weights and the bias."""
        n, pos = len(self.y), self.y.sum()
        share = np.where(self.y == 1, 0.5 / pos, 0.5 / (n - pos))
        z = bias + np.bincount(self.sent_of, w[self.word_of], len(self.doc_of))
        q, q0 = 1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 / (1 + np.exp(-bias))
        none = np.bincount(self.doc_of, np.log1p(-np.minimum(q, 1 - 1e-12)), n) + self.plain * np.log1p(-q0)
        prob = -np.expm1(np.minimum(none, -1e-12))
        slope = np.where(self.y == 1, -(1 - prob) / prob, 1.0) * share  # by the logit of one sentence, over its p
        gz = slope[self.doc_of] * q
        loss = -(share * np.where(self.y == 1, np.log(prob), none)).sum()
        return float(loss), np.bincount(self.word_of, gz[self.sent_of], len(w)), float(gz.sum() + (slope * self.plain).sum() * q0)


def train(texts: list[str], labels: list[int], p: Params = Params()) -> Model:
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(-20.0 if not y.sum() else 20.0, {}, p.sentence_at)
    bags = [[s.split() for s in sentences(t)] for t in texts]
    bags = [[s for s in b if s] for b in bags]
    seen, bad = Counter(), Counter()
    for b, v in zip(bags, y, strict=True):
        words = {w for s in b for w in s}
        seen.update(words)
        if v:
            bad.update(words)
    pos, n = y.sum(), len(y)
    # how many standard errors a word's share among toxic documents is above that among others: the rest would be learnt by heart
    rate = {w: (bad[w] / pos, (c - bad[w]) / (n - pos), (c + 1) / (n + 2)) for w, c in seen.items() if bad[w] >= p.least_docs}
    gain = {w: (a - b) / np.sqrt(m * (1 - m) * (1 / pos + 1 / (n - pos))) for w, (a, b, m) in rate.items()}
    words = sorted((w for w in gain if gain[w] >= p.least_errors), key=lambda w: (-gain[w], w))[: p.vocabulary]
    index = {w: i for i, w in enumerate(words)}
    bag = Bags.of(bags, index, y)
    w, bias = np.zeros(len(words)), -6.0
    m, v = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    for t in range(1, p.steps + 1):
        _, gw, gb = bag.loss(w, bias)
        g = np.append(gw + p.decay * w * 0.1, gb)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias = min(-2.0, bias - step[-1])
    keep = np.abs(w) > 1e-3
    return Model(float(bias), {x: float(w[i]) for i, x in enumerate(words) if keep[i]}, p.sentence_at)


def score(model: Model, text: str | None) -> tuple[float, int, list[tuple[int, int, float]]]:
    """(noisy-or of the sentences, sentences, offending ones as code point start, end, p)."""
    if not text:
        return 0.0, 0, []
    get, bias = model.weights.get, model.bias
    none = np.log1p(-1 / (1 + np.exp(-bias)))
    total, count, plain, at, bad = 0.0, 0, 0, 0, []
    pieces = sentences(text)
    for s in pieces:
        words = s.split()
        if words:
            count += 1
            known = [x for x in map(get, set(words)) if x is not None]
            if known:
                q = 1 / (1 + np.exp(-max(-30.0, min(30.0, bias + sum(known)))))
                total += np.log1p(-min(q, 1 - 1e-12))
                if q >= model.sentence_at:
                    bad.append((at, at + len(s), float(q)))
            else:
                plain += 1
        at += len(s) + 1
    if bad:  # from bytes to code points
        raw = text.lower().encode()
        whole = len(text.lower()) == len(text)
        point = lambda b: len(raw[:b].decode(errors="ignore")) if whole else min(len(text), len(raw[:b].decode(errors="ignore")))
        bad = [(point(a), point(b), q) for a, b, q in bad]
    return float(min(1.0, max(0.0, -np.expm1(total + plain * none)))), count, bad


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> list:
    """Rows (text, toxic) outside the held-out fold: about max_rows, chosen by a hash of doc_id within each class, the same ones in every run."""
    key = F.col("doc_id")
    known = labels.select("doc_id", "toxic").filter(key.isNotNull() & F.col("toxic").isNotNull() & ~held_out(key)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sizes = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    each = p.max_rows // 2
    take = F.when(F.col("y") == 1, min(1.0, each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, (p.max_rows - min(each, sizes.get(1, 0))) / max(1, sizes.get(0, 0))))
    drawn = F.pmod(F.xxhash64(key, F.lit(p.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.filter(drawn < take).orderBy(drawn, "doc_id").limit(2 * p.max_rows)  # so a bounded broadcast
    rows = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id").filter(F.col("t").isNotNull())
    first = rows.select("doc_id", "t", "y").orderBy(drawn, "doc_id", F.xxhash64("t"), "t").limit(4 * p.max_rows)
    return sorted(first.collect(), key=lambda r: (r.doc_id, r.t))


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    rows = labelled_sample(docs, labels, p)
    return train([r.t for r in rows], [r.y for r in rows], p)


def scorer(spark: SparkSession, model: Model):
    """A column function text -> struct(score, n_sentences, offending)."""
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])

    @F.arrow_udf(RESULT)
    def toxicity(text: pa.Array) -> pa.Array:
        found = [score(held.value, t.as_py()) for t in text]
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32()), pa.array([[dict(zip(("start", "end", "p"), s, strict=True)) for s in x[2]] for x in found], pa.list_(span))],
            ["score", "n_sentences", "offending"],
        )

    return toxicity
