"""Exact dedup by heavy-hitter split.

A Misra-Gries summary finds the digests that can hold more than 1/(k+1) of all rows. Their counts are then
verified exactly, and these winners (k rows at most, so a bounded broadcast) settle their copies map-side.
The remaining digests, none of them frequent, go through an ordinary shuffle.

Cases: a null text counts as empty; a null doc_id is larger than any other; of equal rows with the same
doc_id one stays; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.session import remove, ship, written

COUNTERS = 1024
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def shrink(counts: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Misra-Gries step for many items at once: subtract the (k+1)-th largest count, keep what is positive."""
    if len(counts) <= k:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - k - 1)[len(values) - k - 1])
    return {d: c - cut for d, c in counts.items() if c > cut}


def _summarise(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in pc.value_counts(batch.column(0)):
                d, n = x["values"].as_py(), x["counts"].as_py()
                counts[d] = counts.get(d, 0) + n
                if len(counts) > 16 * k:
                    counts = shrink(counts, k)
        counts = shrink(counts, k)
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["d", "n"])

    return run


def heavy_hitters(digests: DataFrame, k: int = COUNTERS) -> list[bytes]:
    """At most k candidates from the single binary column of digests; every value of over rows/(k+1) is among them."""
    ship(digests.sparkSession)
    parts = digests.mapInArrow(_summarise(k), "d binary, n long")
    top = parts.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(k + 1).collect()
    counts = shrink({bytes(r.d): r.n for r in top}, k)
    return [d for d, n in counts.items() if n > 1]


def _groups(rows: DataFrame) -> DataFrame:
    """Per digest d: the smallest doc_id, the rows, and how many rows have that smallest doc_id."""
    per_id = rows.groupBy("d", "id").agg(F.count("*").alias("c"))
    return per_id.groupBy("d").agg(F.min("id").alias("keep"), F.sum("c").alias("size"), F.min_by("c", F.coalesce("id", F.lit(2**63 - 1))).alias("ties"))


def settle(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, hot, rest): rows has (id, d) of every document; hot and rest have one row per digest with d, keep, size, ties."""
    rows = written(spark, docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("d")), "digests")
    candidates = heavy_hitters(rows.select("d"), k)
    names = spark.createDataFrame([(bytearray(d),) for d in candidates], "d binary")
    hot = written(spark, _groups(rows.join(F.broadcast(names), "d", "left_semi")), "hot")  # k rows at most
    rest = _groups(rows.join(F.broadcast(hot.select("d")), "d", "left_anti"))
    return rows, hot, rest


def groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, hot, rest = settle(spark, docs, id_col, text_col, k)
    light = rows.join(F.broadcast(hot.select("d")), "d", "left_anti")
    told = rows.join(F.broadcast(hot), "d").unionByName(light.join(rest, "d"))
    first = told["id"].eqNullSafe(told["keep"])
    out = lambda df, kept: df.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("d")).alias("text_sha256"))
    plain = told.filter(~first | (F.col("ties") == 1))
    tied = told.filter(first & (F.col("ties") > 1)).groupBy("d", "id", "keep", "size").agg(F.count("*").alias("c"))
    tied = tied.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    return out(plain, first).unionByName(out(tied, F.col("copy") == 1))


def keep_first(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns. Copies of frequent texts go before the shuffle, by the winners' broadcast."""
    rows, hot, rest = settle(spark, docs, id_col, text_col, k)
    rest = written(spark, rest.filter("size > 1"), "groups")
    light = rows.join(F.broadcast(hot.select("d")), "d", "left_anti").join(rest, "d")
    losers = written(spark, light.filter(~F.col("id").eqNullSafe(F.col("keep"))).select(F.col("d").alias("__d"), F.col("id").alias("__id")).distinct(), "losers")
    tied = hot.unionByName(rest).filter("ties > 1").select(F.col("d").alias("__d"), F.col("keep").alias("__keep"))
    wins = hot.select(F.col("d").alias("__d"), F.col("keep").alias("__keep"))
    # the row travels whole in one column, so no name of its columns can clash with ours
    d = docs.select(F.struct("*").alias("row"), digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("own"))
    won = d.join(F.broadcast(wins), F.col("digest") == F.col("__d"), "left")
    won = won.filter(F.col("__d").isNull() | F.col("own").eqNullSafe(F.col("__keep"))).drop("__d", "__keep")
    # a join of texts with all losers grows with the input, so it is a shuffled one at every size
    left = won.join(losers.hint("merge"), (F.col("digest") == F.col("__d")) & F.col("own").eqNullSafe(F.col("__id")), "left_anti")
    tied = written(spark, tied, "tied")
    once = left.join(tied, F.col("digest") == F.col("__d"), "left_anti")
    if not tied.isEmpty():
        many = left.join(tied, F.col("digest") == F.col("__d"), "left_semi")
        once = once.unionByName(many.dropDuplicates(["digest"]))
    remove(spark, rows)
    return once.select("row.*")
