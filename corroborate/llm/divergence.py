"""Source divergence audit by wide term vectors.

Tasks count the terms of their texts and sum them up before any shuffle; what too few documents hold goes before the
counts by source are shuffled. Each kept term of a language is then pivoted into one array indexed by source, and
higher-order functions turn the counts into exact whole-number shares and emit, per term, each pair of sources with the
distance of their shares; map-side aggregation sums these to one row a pair and task.

A language's sources (names, numbers of terms) are one row. Languages of many terms take it by broadcast, the others
by an ordinary join, and what is joined has one row a term, so no key holds the rows of a hot source. The result has a row
for each ordered pair of sources: their number is bounded by the contract, and the arrays by it.

Cases: null text, lang and source are empty strings; a document without terms still makes its group occur; a
repeated row counts as a further document; a language without kept terms has distance 0 for all pairs and no terms;
a lone source has no pair; a term of over 2**62 occurrences would overflow; ties rank by the item's UTF-8 bytes; other
columns are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.operators.retrieval import small
from corroborate.session import answered, remove, ship, written

LEAST_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
BLOCK = 16 << 20  # bytes of text that a task counts together
# bytes of UTF-8: A-Z in lower case, other ASCII signs but a-z a blank, the rest as they are
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def tokens(text: pa.Array) -> pa.Array:
    """Of strings the lists of their terms, with empty strings among them where a text begins or ends with other signs."""
    if text.offset:
        text = pa.concat_arrays([text, text.slice(0, 0)])
    none, offsets, signs = text.buffers()
    mapped = _TABLE[np.frombuffer(signs, np.uint8)] if signs is not None and signs.size else np.empty(0, np.uint8)
    return pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(text), [none, offsets, pa.py_buffer(mapped)], offset=text.offset))


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return [key[at], *[np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]]


def _block(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of texts (lang, i, text) one row for each language and term: in how many texts it is, and its occurrences by source."""
    lang, source = rows.column(0).dictionary_encode(), rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = tokens(rows.column(2))
    coded = lists.flatten().dictionary_encode()
    code, many, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary)), int(source.max(initial=0)) + 1
    doc = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    empty = pc.index(coded.dictionary, "").as_py()
    key, n = np.unique((doc * many + code)[code != empty], return_counts=True)
    doc, code = key // many, key % many
    of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, n, docs = _sums((of[doc] * many + code) * width + source[doc], n, np.ones(len(key), np.int64))
    term, at, docs = _sums(key // width, np.ones(len(key), np.int64), docs)
    offsets = pa.array(np.append(0, np.cumsum(at)).astype(np.int32))
    by = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((key % width).astype(np.int32), n)]
    return pa.record_batch([lang.dictionary.take(pa.array(term // many)), coded.dictionary.take(pa.array(term % many)), pa.array(docs), *by], ["lang", "term", "docs", "i", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > BLOCK:
            yield _block(pa.concat_batches(held))
            held = []
    if held:
        yield _block(pa.concat_batches(held))


def counted(docs: DataFrame) -> DataFrame:
    """Of texts (lang, i: number of the source, text) parts (lang, term, docs, i, n) that add up: documents that hold a term, and its occurrences n by source i."""
    ship(docs.sparkSession)
    return docs.select("lang", "i", "text").mapInArrow(_count, "lang string, term string, docs long, i array<int>, n array<long>")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE*(count+SMOOTH) / (total+SMOOTH*kept)), exact."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), whole(total + kept * SMOOTH))


def added(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def vectors(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(wide, langs): wide has (lang, term, counts) of each kept term, counts by place of the source in langs; langs has (lang, kept, sources, totals, total)."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = rows.groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("g"))
    groups = written(spark, groups.select("lang", F.posexplode("g").alias("i", "g")).select("lang", F.col("g").alias("source"), "i"), "groups")
    parts = written(spark, counted(rows.join(small(groups), ["lang", "source"])), "counts")
    kept = parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = written(spark, kept.select("lang", "term").withColumn("k", F.monotonically_increasing_id()), "kept")
    # by broadcast where the kept terms are few, so that the many rare ones go before a shuffle
    each = parts.join(small(kept), ["lang", "term"]).select("k", F.explode(F.arrays_zip("i", "n")).alias("x")).groupBy("k", "x.i").agg(F.sum("x.n").alias("n"))
    by = each.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("by"))
    width = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    many = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    sized = written(spark, width.join(many, "lang", "left").select("lang", "sources", F.coalesce("kept", F.lit(0)).alias("kept")), "sized")
    wide = kept.join(by, "k").join(small(sized), "lang")
    places = F.transform(F.sequence(F.lit(0), F.col("sources").cast("int") - 1), lambda i: F.coalesce(F.element_at("by", i), F.lit(0)))
    wide = written(spark, wide.select("lang", "term", places.alias("counts")), "wide")
    totals = wide.select("lang", F.posexplode("counts").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"))
    langs = groups.join(totals, ["lang", "i"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "source", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))
    langs = written(spark, langs.join(sized, "lang").select("lang", "kept", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), added(F.col("g.n")).alias("total")), "langs")
    for t in (groups, parts, kept, sized):
        remove(spark, t)
    return wide, langs


def audit(spark: SparkSession, docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: distances of a language's sources, and the terms that a source has more of than its language."""
    wide, langs = vectors(spark, docs, least)
    met = answered(wide, langs, "lang", "kept", wide.count())
    shares = F.zip_with("counts", "totals", lambda c, n: share(c, n, F.col("kept")))
    met = written(spark, met.select("lang", "term", "sources", "counts", share(added(F.col("counts")), F.col("total"), F.col("kept")).alias("q"), shares.alias("p")), "shares")
    remove(spark, wide)

    # each pair of a language's sources once, by their places; every language's pairs count at least 0
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y, k: F.struct(i.alias("i"), (i + k + 1).alias("j"), F.abs(x - y).alias("f")))))
    nothing = langs.select("lang", F.transform("sources", lambda s: F.lit(0).cast("long")).alias("p"))
    sums = met.select("lang", "p").unionByName(nothing).select("lang", F.inline(pairs)).groupBy("lang", "i", "j").agg(F.sum("f").alias("value"))
    named = sums.join(langs.select("lang", "sources"), "lang")
    one, two = F.get("sources", F.col("i")), F.get("sources", F.col("j"))
    both = F.inline(F.array(F.struct(one.alias("source"), two.alias("item")), F.struct(two.alias("source"), one.alias("item"))))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = named.select("lang", "value", both).withColumn("rank", F.row_number().over(order))

    above = F.filter(F.arrays_zip("sources", "counts", "p"), lambda x: (x["counts"] > 0) & (x["p"] > F.col("q")))
    found = met.select("lang", F.col("term").alias("item"), "q", F.explode(above).alias("x")).select("lang", F.col("x.sources").alias("source"), "item", (F.col("x.p") - F.col("q")).alias("value"))
    term = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pair, "pair").unionByName(columns(term, "term"))
