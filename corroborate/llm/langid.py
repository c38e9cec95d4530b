"""Language ID with error-correcting output codes.

Each language has a codeword; one binary classifier per bit reads character n-grams of the whole text and
predicts that bit. Decoding adds up the bits' logistic losses, each bit weighted by its accuracy in training,
and takes the language of the least loss. An answer is ambiguous if the second language's loss is nearly as
small, or if even the nearest codeword is far: its weighted mean loss a bit is over that of a coin's toss, times `far`.

Cases: a null text, an empty one or one with no letter (Unicode category L) is `und` with score 0 and not ambiguous;
with no labelled row at all every text is `und`; equal losses go to the language first in the alphabet; a null doc_id
is never learned from and not held out; rows that share a doc_id are drawn by their texts, equal rows together and
as often as they come, up to four times the sample; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import ship

UND = "und"
RESULT = "struct<lang_pred:string,score:double,ambiguous:boolean>"
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Params:
    """max_rows bounds the labelled rows that training reads, shared evenly by the languages, but at least one of each: none is left out.

    gap: an answer is ambiguous if the second language's loss exceeds the first's by less. far: or if the first's weighted mean
    loss a bit is over far times log 2."""

    dims: int = 4096
    max_rows: int = 3200
    steps: int = 120
    rate: float = 0.5
    decay: float = 1e-5
    gap: float = 0.2
    far: float = 0.7
    seed: int = 7


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # dims+1 x bits
    trust: np.ndarray  # bits
    gap: float
    far: float = 0.7


@lru_cache(1)
def _folded() -> bytes:
    """Of each byte what the n-grams see: ASCII letters and bytes of longer characters stay, all else is a space."""
    return bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(texts: list[str], dims: int) -> np.ndarray:
    """Per text the square roots of its hashed 1- to 3-gram counts, scaled to length 1, and a constant."""
    out = np.zeros((len(texts), dims + 1), np.float32)
    shift = np.uint32(32 - dims.bit_length() + 1)
    blank = (np.array([32, 32 * 258, 32 * (258 + 66049)], np.uint32) * np.uint32(2654435761)) >> shift
    for row, text in zip(out, texts, strict=True):
        a = np.frombuffer(f" {text.lower()} ".encode().translate(_folded()), np.uint8).astype(np.uint32)
        two = a[:-1] + a[1:] * np.uint32(257)
        three = two[:-1] + a[2:] * np.uint32(66049)
        grams = np.concatenate([a, two, three])
        counts = np.bincount((grams * np.uint32(2654435761)) >> shift, minlength=dims)
        counts[blank] = 0
        row[:dims] = np.sqrt(counts)
        row[:dims] /= max(1e-9, float(np.linalg.norm(row[:dims])))
    out[:, dims] = 1
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n rows of -1 and 1: every split of the classes in two for up to 7 classes, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if c == 0 else (1 if b >> (c - 1) & 1 else -1) for b in range(2 ** (n - 1) - 1)] for c in range(n)], float)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, far = None, -1
    for _ in range(100):
        code = rng.choice([-1.0, 1.0], (n, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, apart.min()
    return best


def train(texts: list[str], langs: list[str], p: Params = Params()) -> Model:
    names = sorted(set(langs))
    code = codewords(len(names), p.seed)
    if not names:
        return Model([], code, np.zeros((p.dims + 1, 1), np.float32), np.ones(1), p.gap, p.far)
    x = features(texts, p.dims)
    y = np.array([names.index(v) for v in langs])
    share = 1.0 / np.bincount(y, minlength=len(names))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    aim = code[y].astype(np.float32)
    w = np.zeros((p.dims + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, p.steps + 1):
        z = x @ w
        g = x.T @ (-aim * share / (1 + np.exp(np.clip(aim * z, -30, 30)))) + p.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= p.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    right = ((x @ w) * aim > 0) * share
    trust = np.clip(2 * right.sum(0) - 1, 0.05, 1.0)
    return Model(names, code, w, trust, p.gap, p.far)


def decode(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, score, ambiguous) of rows of bit margins."""
    ones, rest = np.logaddexp(0, -margins) * model.trust, np.logaddexp(0, margins) * model.trust  # losses of a bit that is 1, -1
    loss = ones @ (model.code.T > 0) + rest @ (model.code.T < 0)
    best, least = loss.argmin(1), loss.min(1)
    score = 1 / np.exp(least[:, None] - loss).sum(1)
    second = np.partition(loss, 1, axis=1)[:, 1] if loss.shape[1] > 1 else loss[:, 0] + np.inf
    return best, score, (second - least < model.gap) | (least > model.far * np.log(2) * model.trust.sum())


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    out: list[tuple[str, float, bool]] = [(UND, 0.0, False)] * len(texts)
    if not model.langs:
        return out
    rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        best, score, vague = decode(model, features([texts[i] for i in part], model.weights.shape[0] - 1) @ model.weights)
        for i, b, s, a in zip(part, best, score, vague, strict=True):
            out[i] = (model.langs[b], float(s), bool(a))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list:
    """Rows (text, lang) outside the held-out fold: of each language those with the least hash of doc_id and text; the same ones in every run.

    Rows in the least part of their language's range of hashes are drawn, twice as many as are wanted, and cut by a heap a task:
    sorts of whole texts would take pages of memory in every task."""
    key = F.col(id_col)
    rows = docs.filter(key.isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(key))
    hashed = F.pmod(F.xxhash64(key, F.lit(p.seed), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), hashed.alias("u"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language, as the model itself has
    if not sizes:
        return []
    each = max(1, p.max_rows // len(sizes))
    part = docs.sparkSession.createDataFrame([(lang, min(1.0, (2 * each + 50) / n)) for lang, n in sizes.items()], "lang string, part double")
    drawn = rows.join(F.broadcast(part), "lang").filter("u <= part").select("text", "lang", (F.col("u") / F.col("part")).alias("u"))
    found = sorted(drawn.orderBy("u", F.xxhash64("text"), "text").limit((4 * each + 100) * len(sizes)).collect(), key=lambda r: (r.lang, r.u, r.text))
    taken = Counter()
    out = []
    for r in found:
        taken[r.lang] += 1
        if taken[r.lang] <= each:
            out.append(r)
    return out


def fit(docs: DataFrame, p: Params = Params(), **cols: str) -> Model:
    rows = labelled_sample(docs, p, **cols)
    return train([r.text for r in rows], [r.lang for r in rows], p)


def predictor(spark: SparkSession, model: Model):
    """A column function text -> struct(lang_pred, score, ambiguous)."""
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def language(text: pa.Array) -> pa.Array:
        found = predict(held.value, text.to_pylist())
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())], ["lang_pred", "score", "ambiguous"])

    return language


def keep_known(spark: SparkSession, docs: DataFrame, p: Params = Params(), languages: tuple[str, ...] | None = None) -> DataFrame:
    """The documents whose language is told: those judged `und`, those whose decoding is ambiguous and those in none of languages (None: any
    that is learned) go. Where no row has a language nothing is learned, so only texts without a letter go."""
    model = fit(docs, p)
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    told = predictor(spark, model)(F.col("text"))
    wanted = told["lang_pred"] != UND if languages is None else told["lang_pred"].isin(list(languages))
    return docs.filter(wanted & ~told["ambiguous"])
