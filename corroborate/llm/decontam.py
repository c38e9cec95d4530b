"""Benchmark decontamination by greedy string tiling.

Seeds are runs of SEED_WORDS equal words, found by a rolling Karp-Rabin hash; an item of fewer words has one seed of its
own length. For every item that shares a seed with a document, the longest match of words that no tile covers yet is
marked again and again, until none of seed length is left. Tiles may come in any order, so a passage whose sentences
were moved is covered too. A document is contaminated by an item when its tiles cover at least COVERAGE of the item's
words.

Seeds are joined, so neither side is held whole anywhere. Not all seeds of an item are needed: if at most u of its words
may stay uncovered, then of any u+1 words one is in a tile, and with it one of the seeds that hold this word. Each item is
joined by the seeds of those u+1 neighbouring words whose seeds the benchmark's items share least, so a stock phrase
of many items is a join key only for items that consist of such phrases. What is broadcast is a Bloom filter of these
seeds, of at most BLOOM_WORDS words at any size of the benchmark; documents are scanned once and those without a hit in
it go no further. Documents and items that share a seed meet in one task per document and bundle of BUNDLE items.

Cases: words are runs of letters and digits, lower-cased; null, empty and wordless texts and items match nothing, nor
do items with a null id; items of equal words are compared once; repeated items count by their item_id, the better
coverage of each; of equal long matches the earlier in the item, then in the document, is taken; equal rows give equal
results, a row each; other columns are never looked at, and whatever their names the rows keep them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import remove, ship, size_bytes, written

SEED_WORDS = 5
COVERAGE = 0.8
BLOOM_WORDS = 1 << 21
LEAST_WORDS = 1 << 17
BUNDLE = 1024
BROADCAST_BYTES = 16 << 20
SALTS = 32
GROUP = 1 << 18  # characters that are hashed at once, or one text
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin values, modulo 2^64, of all runs of n ids: each from the last by taking one id in and one out."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    power = np.cumprod(np.full(n, _BASE, np.uint64))[::-1]
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out += x[k : len(x) - n + 1 + k] * power[k]
    return out


@lru_cache(1)
def _signs() -> np.ndarray:
    """Which code points words are made of."""
    return np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), np.uint8).astype(bool)


@lru_cache(8)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of the base and of its inverse modulo 2^64."""
    up, down = (np.full(1 << bits, x, np.uint64) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def spelled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Of the words of all texts a value of their letters, alike wherever the word stands, and which text they are in."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(np.diff(_signs()[points].astype(np.int8), prepend=0, append=0))
    a, b = ends[::2], ends[1::2]
    up, down = _powers(max(10, len(points).bit_length()))
    upto = np.append(np.uint64(0), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], dtype=np.uint64))
    h = (upto[b] - upto[a]) * down[a]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29)), np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), a, "right")


def seeds(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin values of all runs of n words, alike in all documents and items, and which text they are in."""
    h, text = spelled(texts)
    value = rolling(h, n)
    own = text[: len(value)] == text[n - 1 :] if len(value) else np.empty(0, bool)
    return value[own], text[: len(value)][own]


def needed(times: np.ndarray, n: int, seed: int, coverage: float) -> slice:
    """Of an item of n words, whose seeds come times times in the benchmark, seeds of which one must match: those of the u+1 neighbouring words with the least total."""
    u = n - max(1, next(k for k in range(n + 1) if k / n >= coverage or k == n))
    total = np.append(0, np.cumsum(times))
    first = np.arange(n - u)  # the u+1 words begin there; their seeds begin from seed-1 before to u after
    lo, hi = np.maximum(0, first - seed + 1), np.minimum(len(times), first + u + 1)
    at = int(np.argmin(total[hi] - total[lo]))
    return slice(int(lo[at]), int(hi[at]))


@dataclass
class Index:
    """Some items as (id, numbers of their words, values of their seeds of n words)."""

    n: int
    vocab: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray, np.ndarray]] = field(default_factory=list)


def build(items: list[tuple[int, str | None]], seed: int = SEED_WORDS) -> Index:
    index = Index(seed)
    for item_id, text in items:
        w = words(text)
        if len(w) >= seed:
            ids = np.array([index.vocab.setdefault(x, len(index.vocab)) for x in w], np.int64)
            index.items.append((item_id, ids, rolling(ids, seed)))
    return index


def tile(item: np.ndarray, doc: np.ndarray, at_item: np.ndarray, at_doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in document, words): the longest match of unmarked words first. at_item, at_doc: shared seeds of least words."""
    order = np.lexsort((at_item, at_doc - at_item))
    i, j = at_item[order], at_doc[order]
    same = np.ones(len(i), bool)
    for k in range(least):  # hashes may collide
        same &= item[i + k] == doc[j + k]
    i, j = i[same], j[same]
    if not len(i):
        return []
    start = np.flatnonzero(np.append(True, ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + 1)))
    size = np.diff(np.append(start, len(i))) + least - 1
    heap = [(-int(n), int(i[s]), int(j[s])) for s, n in zip(start, size, strict=True)]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = in_item[a : a + n] | in_doc[b : b + n]
        if not taken.any():
            in_item[a : a + n] = in_doc[b : b + n] = True
            out.append((a, b, n))
            if in_item.all():
                break
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))  # ends of its unmarked runs
        for s, e in zip(free[::2], free[1::2], strict=True):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return out


def hits(index: Index, text: str | None) -> list[tuple[int, float, int, int]]:
    """(item_id, coverage, tiles, words of the longest tile) of the items that share a seed with the text."""
    w, n = words(text), index.n
    ids = np.fromiter(map(index.vocab.get, w, repeat(-1)), np.int64, len(w))
    if len(ids) < n:
        return []
    known = ids >= 0
    runs = np.ones(len(ids) - n + 1, bool)
    for k in range(n):
        runs &= known[k : len(ids) - n + 1 + k]
    at = np.flatnonzero(runs)
    value = rolling(ids, n)[at]
    order = np.argsort(value, kind="stable")
    at, value = at[order], value[order]
    out: dict[int, tuple[int, float, int, int]] = {}
    for item_id, item_ids, h in index.items:
        lo, hi = np.searchsorted(value, h), np.searchsorted(value, h, "right")
        count = hi - lo
        if not count.any():
            continue
        rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        tiles = tile(item_ids, ids, np.repeat(np.arange(len(h)), count), at[rows], n)
        if tiles:
            sizes = [t[2] for t in tiles]
            hit = (item_id, sum(sizes) / len(item_ids), len(tiles), max(sizes))
            out[item_id] = max(out.get(item_id, hit), hit)
    return sorted(out.values())


def _items(spark: SparkSession, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, members): distinct items (cls, w: their words), and (cls, item_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([" ".join(words(t.as_py())) for t in batch.column(1)], pa.string())], ["item_id", "w"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    items = written(spark, rows.mapInArrow(run, "item_id long, w string").filter("w <> ''"), "items")
    classes = written(spark, items.select("w").distinct().select(F.monotonically_increasing_id().alias("cls"), "w"), "classes")
    members = written(spark, items.join(classes, "w").select("cls", "item_id").distinct(), "members")
    remove(spark, items)
    return classes, members


def _all_seeds(seed: int):
    """Of rows (cls, w) the item's seeds in order: (cls, at, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = w.count(" ") + 1
                h = seeds([w], min(seed, n))[0].view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(h), cls)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(np.full(len(h), n, np.int32)), pa.array(h)], ["cls", "at", "n", "h"])

    return run


def _choose(seed: int, coverage: float):
    """Of rows (cls, n, l: times and hashes of its seeds in order) the seeds needed: (cls, h, n: words of a seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cls, n, l in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                took = l[needed(np.array([x["times"] for x in l]), n, min(seed, n), coverage)]
                h = sorted({x["h"] for x in took})
                yield pa.record_batch([pa.array([cls] * len(h), pa.int64()), pa.array(h, pa.int64()), pa.array([min(seed, n)] * len(h), pa.int32())], ["cls", "h", "n"])

    return run


def _keys(spark: SparkSession, classes: DataFrame, coverage: float, seed: int) -> DataFrame:
    """The seeds (cls, h, n) by which items are joined."""
    every = classes.mapInArrow(_all_seeds(seed), "cls long, at int, n int, h long")
    times = every.groupBy("h").agg(F.count("*").alias("times"))
    each = every.join(times, "h").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("at", "times", "h"))).alias("l"))
    return written(spark, each.select("cls", "n", "l").mapInArrow(_choose(seed, coverage), "cls long, h long, n int"), "seeds")


def _place(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, mask) of hashes in a filter of size words: up to four bits of one word."""
    mask = np.zeros(len(h), np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return (h >> np.uint64(24)) % np.uint64(size), mask


def _bloom(keys: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A filter of the seeds, of four words a seed but at least LEAST_WORDS and never more than BLOOM_WORDS, and the lengths of the seeds (at most SEED_WORDS)."""
    n, lengths = keys.agg(F.count("*"), F.collect_set("n")).first()
    size = 1 << min(BLOOM_WORDS.bit_length() - 1, max(LEAST_WORDS.bit_length() - 1, (4 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = _place(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            yield pa.record_batch([pa.array(at.view(np.int64)), pa.array(mask.view(np.int64))], ["at", "mask"])

    rows = keys.select("h").mapInArrow(run, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(size, np.uint64)
    bits[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return bits, sorted(lengths)


def _prober(spark: SparkSession, keys: DataFrame):
    """A column function text -> the distinct values of its seeds that the filter lets through."""
    held = spark.sparkContext.broadcast(_bloom(keys))

    def found(texts: list[str | None]) -> Iterator[np.ndarray]:
        bits, lengths = held.value
        value, text = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for n in lengths:
            h, of = seeds(texts, n)
            at, mask = _place(h, len(bits))
            hit = bits[at] & mask == mask
            value.append(h[hit])
            text.append(of[hit])
        value, text = np.concatenate(value).view(np.int64), np.concatenate(text)
        order = np.argsort(text, kind="stable")
        for x in np.split(value[order], np.searchsorted(text[order], np.arange(1, len(texts)))):
            yield np.unique(x)

    @F.arrow_udf("array<long>")
    def probe(text: pa.Array) -> pa.Array:
        out, group, room = [], [], GROUP
        for t in text:
            group.append(t.as_py())
            room -= len(group[-1] or "")
            if room <= 0:
                out += found(group)
                group, room = [], GROUP
        if group:
            out += found(group)
        return pa.array(out, pa.list_(pa.int64()))

    return probe


def _met(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """rows joined by key with the benchmark's side. This is broadcast if its size allows, else it is dealt SALTS times, so that a key with many rows meets it in as many tasks."""
    if size_bytes(other) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(other), key)
    salt = F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt")
    return rows.select("*", salt).join(other.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), [key, "salt"]).drop("salt")


def _tiled(seed: int, coverage: float):
    """Of rows (uid, text, items: (cls, w) that may be in it) those that its tiles cover enough: (uid, cls, coverage, n_tiles, longest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                by_length: dict[int, list[tuple[int, str]]] = {}
                for x in items:
                    by_length.setdefault(min(seed, x["w"].count(" ") + 1), []).append((x["cls"], x["w"]))
                for n, some in by_length.items():
                    out += [(uid, *hit) for hit in hits(build(some, n), text) if hit[1] >= coverage]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], ["uid", "cls", "coverage", "n_tiles", "longest"])

    return run


def _covered(spark: SparkSession, hit: DataFrame, classes: DataFrame, keys: DataFrame, coverage: float, seed: int) -> DataFrame:
    """(uid, cls, coverage, n_tiles, longest) of the rows (uid, text, hits) of hit and the items that contaminate them."""
    pairs = _met(hit.select("uid", F.explode("hits").alias("h")), keys.select("h", "cls"), "h").select("uid", "cls").distinct()
    many = pairs.groupBy("uid").agg(F.count("*").alias("n"))
    bundled = pairs.join(many, "uid").select("uid", "cls", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BUNDLE)).alias("bundle"))
    items = _met(bundled, classes, "cls").groupBy("uid", "bundle").agg(F.collect_list(F.struct("cls", "w")).alias("items"))
    both = hit.select("uid", "text").join(items, "uid").select("uid", "text", "items")
    return both.mapInArrow(_tiled(seed, coverage), "uid long, cls long, coverage double, n_tiles int, longest int")


def contaminations(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, coverage, n_tiles, longest."""
    ship(spark)
    classes, members = _items(spark, benchmark)
    keys = _keys(spark, classes, coverage, seed)
    probed = docs.select("doc_id", "text", _prober(spark, keys)(F.col("text")).alias("hits")).filter(F.size("hits") > 0)
    hit = written(spark, probed.withColumn("uid", F.monotonically_increasing_id()), "hits")
    found = _met(_covered(spark, hit, classes, keys, coverage, seed), members, "cls")
    best = found.groupBy("uid", "item_id").agg(F.max(F.struct("coverage", "n_tiles", "longest")).alias("x"))
    out = written(spark, best.join(hit.select("uid", "doc_id"), "uid").select("doc_id", "item_id", "x.coverage", "x.n_tiles", "x.longest"), "contaminations")
    for t in (classes, members, keys, hit):
        remove(spark, t)
    return out


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Those without a hit in the filter are never shuffled."""
    ship(spark)
    classes, members = _items(spark, benchmark)
    keys = _keys(spark, classes, coverage, seed)
    probed = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"), _prober(spark, keys)(F.col("text")).alias("hits"))
    # the row travels whole in one column, so no name of its columns can clash with ours
    marked = written(spark, probed.select("row", F.when(F.size("hits") > 0, F.col("text")).alias("text"), "hits").withColumn("uid", F.monotonically_increasing_id()), "marked")
    hit = marked.filter(F.size("hits") > 0)
    bad = written(spark, _covered(spark, hit.select("uid", "text", "hits"), classes, keys, coverage, seed).select("uid").distinct(), "contaminated")
    for t in (classes, members, keys):
        remove(spark, t)
    left = hit.join(bad, "uid", "left_anti")
    return marked.filter(F.size("hits") == 0).select("row.*").unionByName(left.select("row.*"))
