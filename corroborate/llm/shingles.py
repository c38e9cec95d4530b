"""Links between texts whose sets of word shingles have a Jaccard similarity of at least a share, exactly.

With share p/q, two such sets have at least ceil(n p/q) members in common, n being the size of either. So in any
order of the shingles the two prefixes of n - ceil(n p/q) + l shingles have l in common (l of the smaller set).
By hash, with l a tenth of n, this leaves few texts but those with copies: passages that are less than a text's
greater part do not reach l. Among those left the rarest shingles go first and l is 1: texts that share one in
their prefixes form groups, and in a group the whole sets decide.

A group's links are given out as a spanning forest, never as all pairs. A group of more than CELL texts is dealt in
blocks of about CELL, each pair of blocks to a task of its own.

Cases: a text of fewer words than a shingle is one shingle; texts without a word are linked to nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.llm.graph import components
from corroborate.session import ship, size_bytes, written

WIDTH = 5
SHARE = (4, 5)
SEED = 42
CELL = 2048
BROADCAST_BYTES = 16 << 20


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64).view(np.int64))


def _common(n: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    return -(-n * share[0] // share[1])


def _spare(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 10)


_HELD = ["key", "t", "v"]


def _prefixes(width: int, share: tuple[int, int]):
    """Of rows (t, text) the prefixes by hash as rows (shingle, t, v) and, of shingles that a batch repeats, one such row and each text's number of them as a row (t, t, v): v is what t needs times 2^32 plus that number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), width) for x in batch.column(1)]
            n = np.array([len(s) for s in sets], np.int64)
            if not n.any():
                continue
            t = batch.column(0).to_numpy(zero_copy_only=False)
            size = np.where(n > 0, np.minimum(n, n - _common(n, share) + _spare(n)), 0)
            need = _spare(_common(n, share)) << 32
            flat, who = np.concatenate([s[:k] for s, k in zip(sets, size, strict=True)]), np.repeat(np.arange(len(n)), size)
            _, first, place, times = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
            many = np.bincount(who[times[place] > 1], minlength=len(n))
            some = many > 0
            yield pa.record_batch([pa.array(np.concatenate([flat[first], t[some]])), pa.array(np.concatenate([t[who[first]], t[some]])), pa.array(np.concatenate([need[who[first]], need[some] + many[some]]))], _HELD)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, t, v) sorted by key those whose key comes again, and those that bring a number: (t, need, n)."""
    rest, told = [np.empty(0, np.int64)] * 3, False
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        n = cols[2] & 0xFFFFFFFF
        if n.any():
            yield pa.record_batch([pa.array(cols[1][n > 0]), pa.array(cols[2][n > 0] >> 32), pa.array(n[n > 0])], ["t", "need", "n"])
        key, t, v = (np.concatenate([r, c[n == 0]]) for r, c in zip(rest, cols, strict=True))
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        hit = np.append(same, False) | np.append(False, same)
        hit[0] &= not told
        told = bool(hit[-1] or (told and len(key) == 1) or (len(same) and same[-1]))
        rest = [key[-1:], t[-1:], v[-1:]]
        yield pa.record_batch([pa.array(t[hit]), pa.array(v[hit] >> 32), pa.array(np.ones(hit.sum(), np.int64))], ["t", "need", "n"])


def forest(names: np.ndarray, sets: list[np.ndarray], share: tuple[int, int] = SHARE) -> list[tuple[int, int]]:
    """Links that connect what pairs of similar sets connect: each step takes up all unvisited neighbours at once."""
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    n = np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    mark = np.zeros(len(values), bool)
    left, out = np.arange(len(sets)), []
    of_left = flat
    while len(left):
        edge, of_left, left = [left[0]], of_left[n[left[0]] :], left[1:]
        while edge and len(left):
            x = edge.pop()
            own = flat[ends[x] - n[x] : ends[x]]
            mark[own] = True
            starts = np.cumsum(n[left]) - n[left]
            hit = np.add.reduceat(mark[of_left].astype(np.int64), starts) * (share[0] + share[1]) >= share[0] * (n[left] + n[x])
            mark[own] = False
            if hit.any():
                out += [(int(names[x]), int(names[y])) for y in left[hit]]
                edge += list(left[hit])
                of_left, left = of_left[np.repeat(~hit, n[left])], left[~hit]
    return out


def _compare(share: tuple[int, int]):
    """Of rows (key, f, s) sorted by key the links (a, b) within each key."""

    def links(f: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.array(forest(np.array(f, np.int64), sets, share), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f, sets = None, [], []
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, key in enumerate(keys):
                if key != now and sets:
                    yield links(f, sets)
                    f, sets = [], []
                now = key
                f.append(names[i])
                sets.append(batch.column(2)[i].values.to_numpy(zero_copy_only=False).copy())
        if sets:
            yield links(f, sets)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(x.as_py(), width) for x in batch.column(2)], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), sets], ["t", "f", "s"])

    return run


def links(spark: SparkSession, texts: DataFrame, names: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE, cell: int = CELL) -> DataFrame:
    """Edges (a, b) of names that connect whatever texts (t, text) are linked by pairs of at least the share; names (t, f) names each t."""
    ship(spark)
    held = texts.select("t", "text").mapInArrow(_prefixes(width, share), "key long, t long, v long")
    found = held.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "t long, need long, n long")
    enough = found.groupBy("t").agg(F.sum("n").alias("n"), F.max("need").alias("need")).filter("n >= need").select("t")
    left = written(spark, names.select("t", "f").dropDuplicates(["t"]).join(enough, "t"), "alike")
    left = F.broadcast(left) if size_bytes(left) <= BROADCAST_BYTES else left
    sets = written(spark, texts.join(left, "t").select("t", "f", "text").mapInArrow(_sets(width), "t long, f long, s array<long>").dropDuplicates(["t"]), "sets")
    each = sets.select("t", F.size("s").alias("n"), F.explode("s").alias("x")).withColumn("times", F.count("*").over(W.partitionBy("x"))).filter("times > 1")
    rare = each.groupBy("t", "n").agg(F.array_sort(F.collect_list(F.struct("times", "x"))).alias("l"))
    size = F.size("l") - F.ceil(F.col("n") * share[0] / share[1]).cast("int") + 1  # shingles of one text come first and link nothing
    prefix = rare.withColumn("k", size).filter("k > 0").select("t", F.explode(F.slice("l", F.lit(1), F.col("k"))).alias("p")).select("t", "p.x")
    met = components(spark, prefix.withColumn("b", F.min("t").over(W.partitionBy("x"))).select(F.col("t").alias("a"), "b"))
    blocks = met.groupBy("root").agg(F.ceil(F.count("*") / cell).cast("int").alias("blocks"))
    dealt = met.join(blocks, "root").select(F.col("node").alias("t"), "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = other.select("t", F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    return sets.join(cells, "t").select("key", "f", "s").repartition("key").sortWithinPartitions("key").mapInArrow(_compare(share), "a long, b long")
