"""SimHash near-dedup by anchor-point covering.

Fingerprints of 64 bits within 3 bits of each other differ by at most 1 bit in one of their two halves. In a
half the codewords of the Hamming code over 31 bits, with the last bit free, are the anchors: a covering code of
radius 1. Each fingerprint's home is the anchor it decodes to, and it is replicated to every anchor within the
covering radius plus the 1 bit, 17 in a half. Of two near fingerprints, the home of either holds both. Per anchor
the homes are compared with all that reached it, and the whole distance decides.

Equal fingerprints are compared once. An anchor's links are given out as a spanning forest, never as all pairs.
An anchor that more than CELL fingerprints reach is crowded. Its members are dealt anew, over many tasks: within
3 bits, one of the four bytes of their other half is equal, so each goes to the four cells (anchor, byte's place,
byte), and from a cell that is crowded again to four cells by every fourth bit. In a cell whatever is near a visited
fingerprint is taken up at once, so dense groups cost little. Fingerprints and groups of many rows are joined apart.

Cases: null texts and texts without a word have fingerprint zero and are linked like others; a text of fewer
than three words is one shingle; a null doc_id is linked but never names a component that has another doc_id;
repeated rows stay rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm import shingles
from corroborate.llm.graph import components
from corroborate.session import answered, remove, ship, written

WIDTH = 3
SEED = 42
BITS = 3
BLOCK = 1 << 16
CELL = 2048


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = np.zeros(64, np.int64)
    n = len(words) - width + 1
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        h = np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False))], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(spark: SparkSession, width: int = WIDTH):
    """A column function text -> fingerprint as a signed long."""
    ship(spark)

    @F.arrow_udf("long")
    def simhash(text: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py(), width) for t in text], np.uint64).view(np.int64))

    return simhash


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Of 31-bit words the XOR of the places, from 1, of their set bits."""
    s = np.zeros(len(words), np.uint32)
    for k in range(5):
        mask = np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1))
        s |= (np.bitwise_count(words & mask).astype(np.uint32) & np.uint32(1)) << np.uint32(k)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(home, others) of 32-bit halves: the anchor within 1, and the up to 16 more within 2; -1 where there are fewer."""
    low, free = half & np.uint32(0x7FFFFFFF), half & np.uint32(0x80000000)
    s = _syndromes(low)
    bit = lambda place: np.where(place > 0, np.uint32(1) << (np.maximum(place, 1) - np.uint32(1)), np.uint32(0)).astype(np.uint32)
    code = low ^ bit(s)
    others = np.full((len(half), 16), -1, np.int64)
    others[:, 0] = (code | (free ^ np.uint32(0x80000000))).astype(np.int64)
    at = np.ones(len(half), np.int64)
    for i in range(1, 32):
        j = s ^ np.uint32(i)
        use = np.flatnonzero((s != 0) & (j > i))  # each unordered pair of places with this syndrome, once
        others[use, at[use]] = ((low[use] ^ bit(np.full(len(use), i, np.uint32)) ^ bit(j[use])) | free[use]).astype(np.int64)
        at[use] += 1
    return (code | free).astype(np.int64), others


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1 << 14):
            f = batch.column(0).slice(at, 1 << 14).to_numpy(zero_copy_only=False)
            u = f.view(np.uint64)
            for side in (0, 1):
                home, others = anchors((u >> np.uint64(32 * side)).astype(np.uint32))
                key = np.concatenate([home[:, None], others], axis=1)
                ok = key >= 0
                yield pa.record_batch([pa.array(key[ok] | side << 32), pa.array(np.repeat(f, 17).reshape(-1, 17)[ok]), pa.array(np.tile(np.arange(17) == 0, (len(f), 1))[ok])], ["anchor", "f", "home"])


def near(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def forest(f: np.ndarray, home: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what near pairs with a home end connect: each step takes up all unvisited neighbours at once."""
    out: list[tuple[int, int]] = []
    left, left_home = f, home
    while len(left):
        edge, edge_home = left[:1], left_home[:1]
        left, left_home = left[1:], left_home[1:]
        while len(edge) and len(left):
            x, h = edge[0], edge_home[0]
            edge, edge_home = edge[1:], edge_home[1:]
            hit = near(left, np.full(len(left), x)) & (left_home | h)
            if hit.any():
                out += [(int(x), int(y)) for y in left[hit]]
                edge, edge_home = np.concatenate([edge, left[hit]]), np.concatenate([edge_home, left_home[hit]])
                left, left_home = left[~hit], left_home[~hit]
    return out


def _links(key: np.ndarray, f: np.ndarray, home: np.ndarray) -> pa.RecordBatch:
    """Links (a, b) of rows sorted by key, within each key."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    size_of = np.repeat(sizes, sizes)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = np.flatnonzero((size_of > 1) & (size_of <= 12))
    for step in range(1, 12):
        i = small[small + step < len(key)]
        i = i[key[i] == key[i + step]]
        i = i[(home[i] | home[i + step]) & near(f[i], f[i + step])]
        a.append(f[i])
        b.append(f[i + step])
    for g in np.flatnonzero(sizes > 12):
        found = forest(f[starts[g] : starts[g] + sizes[g]], home[starts[g] : starts[g] + sizes[g]])
        a.append(np.array([x for x, _ in found], np.int64))
        b.append(np.array([y for _, y in found], np.int64))
    pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 1]), pa.array(pairs[:, 0]), pa.nulls(len(pairs), pa.bool_())], ["a", "b", "home"])


def _compare(cell: int | None):
    """Of rows (anchor, f, home) sorted by anchor the links (a, b, null); the members (anchor, f, home) of anchors with over cell rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        crowded = None

        def split(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal crowded
            key = cols[0]
            sizes = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
            out = np.repeat(sizes > cell, sizes) | (key == crowded if crowded is not None else False) if cell else np.zeros(len(key), bool)
            if out.any():
                crowded = int(key[out][-1])
                yield pa.record_batch([pa.array(c[out]) for c in cols], ["a", "b", "home"])
            if not out.all():
                yield _links(*(c[~out] for c in cols))

        for batch in batches:
            cols = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
            if cell and len(cols[0]) - cut > cell:
                cut = len(cols[0])
            rest = [c[cut:] for c in cols]
            if cut:
                yield from split([c[:cut] for c in cols])
        if len(rest[0]):
            yield from split(rest)

    return run


_LINK = "a long, b long, home boolean"


def _deal(crowded: DataFrame, cut: list) -> DataFrame:
    """Members (a: key whose lowest bit or bit 32 tells the anchor's half, b: fingerprint, home) of crowded keys, each to the four cells (key, part, value) of its other half."""
    cells = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("v")) for k, c in enumerate(cut)])
    key = F.xxhash64("a", "c.k", "c.v").bitwiseAND(~1).bitwiseOR(F.col("side"))
    return crowded.select("a", "b", "home", "side", F.explode(cells).alias("c")).select(key.alias("anchor"), F.col("b").alias("f"), "home")


def links(spark: SparkSession, distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect whatever distinct fingerprints f are linked by pairs within BITS."""
    ship(spark)
    compared = lambda rows, most: rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare(most), _LINK)
    reached = distinct.select("f").mapInArrow(_replicate, "anchor long, f long, home boolean")
    found = written(spark, compared(reached, cell), "links")
    out = found.filter("home is null").select("a", "b")
    other = F.when(F.col("side") == 0, F.shiftrightunsigned("b", 32)).otherwise(F.col("b").bitwiseAND(0xFFFFFFFF))  # the half that is not the anchor's
    by_byte = [F.shiftrightunsigned(other, 8 * k).bitwiseAND(255) for k in range(4)]
    by_turn = [other.bitwiseAND(0x11111111 << k) for k in range(4)]  # every fourth bit
    crowded = found.filter("home is not null").withColumn("side", F.shiftright("a", 32))
    if crowded.isEmpty():
        return out
    # within BITS one of four parts of the other half is equal, however it is cut: first in bytes, then, where a cell is crowded again, by every fourth bit
    again = written(spark, compared(_deal(crowded, by_byte), cell), "links")
    out = out.unionByName(again.filter("home is null").select("a", "b"))
    crowded = again.filter("home is not null").withColumn("side", F.col("a").bitwiseAND(1))
    if crowded.isEmpty():
        return out
    return out.unionByName(compared(_deal(crowded, by_turn), None).select("a", "b"))


def _linked(spark: SparkSession, rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(f, component_id, n: how many rows have it) of the distinct fingerprints in rows (id, f). more: edges (a, b) beside those of near fingerprints."""
    distinct = written(spark, rows.groupBy("f").agg(F.min("id").alias("id"), F.count("*").alias("n")), "fingerprints")
    edges = links(spark, distinct)
    roots = components(spark, edges if more is None else edges.unionByName(more))
    rooted = written(spark, distinct.join(roots.select(F.col("node").alias("f"), "root"), "f", "left"), "rooted")
    alone, together = rooted.filter("root is null"), rooted.filter("root is not null")
    named = together.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    whole = answered(together, named, "root", "members", together.count())
    out = written(spark, whole.select("f", "component_id", "n").unionByName(alone.select("f", F.col("id").alias("component_id"), "n")), "linked")
    for t in (distinct, edges, rooted, roots):
        remove(spark, t)
    return out


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    simhash = fingerprints(spark)
    rows = written(spark, docs.select(F.col(id_col).alias("id"), simhash(F.col(text_col)).alias("f")), "simhash")
    return answered(rows, _linked(spark, rows), "f", "n", rows.count()).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: tuple[int, tuple[int, int]] | None = None) -> DataFrame:
    """Of each group the document with the smallest doc_id, with all its columns; of several with that doc_id one.

    similar: (words of a shingle, least Jaccard similarity p/q) of pairs that are linked too, whatever their fingerprints."""
    simhash = fingerprints(spark)
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = written(spark, docs.select(F.col(id_col).alias("id"), text.alias("t"), simhash(F.col(text_col)).alias("f")), "simhash")
    more = shingles.links(spark, docs.select(text.alias("t"), F.col(text_col).alias("text")), rows, *similar) if similar else None
    linked = _linked(spark, rows, more)
    known = written(spark, answered(rows, linked, "f", "n", rows.count()).select("id", "t", "component_id"), "grouped")
    remove(spark, rows)
    remove(spark, linked)
    first = known.filter(F.col("id").eqNullSafe(F.col("component_id")))
    best = first.groupBy("component_id").agg(F.min("t").alias("best"), F.count("*").alias("n")).filter("n > 1")
    best = written(spark, best, "ties")
    later = known.filter(~F.col("id").eqNullSafe(F.col("component_id")))
    tied = first.join(best, first["component_id"].eqNullSafe(best["component_id"])).filter("t <> best")
    losers = written(spark, later.select(F.col("id").alias("__id"), F.col("t").alias("__t")).unionByName(tied.select(F.col("id").alias("__id"), F.col("t").alias("__t"))).distinct(), "losers")
    # the row travels whole in one column, so no name of its columns can clash with ours
    d = docs.select(F.struct("*").alias("row"), text.alias("t"), F.col(id_col).alias("own"))
    left = d.join(losers.hint("merge"), F.col("own").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t")), "left_anti")
    if best.isEmpty():
        return left.select("row.*")
    again = best.select(F.col("component_id").alias("__id"), F.col("best").alias("__t"))
    same = F.col("own").eqNullSafe(F.col("__id")) & (F.col("t") == F.col("__t"))
    once = left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["own", "t"]))
    return once.select("row.*")
