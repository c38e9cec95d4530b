"""Mixing sources to target weights by min-cost flow.

Sources overlap where they hold the same text. A text's membership pattern is the set of sources that hold it; words
are aggregated by pattern, and by pattern and source. The flow routes words from patterns to the sources' quotas: to take
each text of a pattern once is free, each further time costs more (convex), within a source a second use of a document costs
more than a first, and no document may be taken over LIMIT times. So a source whose texts others hold too leaves those to them
where its own suffice, and the whole mix repeats as little as the quotas allow. Quotas are met to the word: of each pattern and source all documents
are taken as often as the flow fills them, and the rest goes to documents in a seeded order, the last of them taken in part.

The driver solves the flow over the sources, which the caller names weights for, and at most PATTERNS patterns, those of
the most words; documents of rarer patterns count as their own source's alone, so that quotas are met all the same. Which
documents the rest reaches is found by three histograms of hashes, never by a sort of a source in one task.

Targets: weights share a total; what is over LIMIT times its source's words is cut there and the excess shared anew by
weight among those below, until none is above.

Cases: a null text has no words; documents without words are taken 0 times; null sources are one source, the last;
equal rows (same id and text) of a source are taken alike, what the order leaves for them being divided evenly, rounded
down; a null id is ordered like others; sources without words have target 0; other columns are never looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.llm.flow import Network
from corroborate.session import answered_or_not, remove, written

WEIGHTS = (3, 1, 2)
SHARE = Fraction(3, 2)
LIMIT = 2
PATTERNS = 1024
SEED = 13
BINS = 12  # bits of a histogram
WORD = r"[^\x20\x09-\x0D]+"
REPEAT = 4  # cost of a further use of a text, against 1 for a further use of a document


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], share: Fraction = SHARE, limit: int = LIMIT) -> list[Fraction]:
    """The exact targets of sources with these sizes."""
    out: list[Fraction | None] = [None] * len(sizes)
    rest = share * sum(sizes)
    while open_ := [k for k, x in enumerate(out) if x is None]:
        total = sum(weights[k] for k in open_)
        cut = [k for k in open_ if rest * weights[k] > limit * sizes[k] * total]
        for k in cut or open_:
            out[k] = Fraction(limit * sizes[k]) if cut else rest * weights[k] / total
        rest -= sum(out[k] for k in cut)
    return out


def route(quotas: list[int], patterns: list[tuple[int, dict[int, int]]], limit: int = LIMIT) -> list[dict[int, int]]:
    """Of each pattern the words for each of its sources. A pattern: words of its different texts, and words of its documents by source."""
    k = len(patterns)
    net = Network(k + len(quotas) + 2)
    start, end = k + len(quotas), k + len(quotas) + 1
    for s, q in enumerate(quotas):
        net.add(k + s, end, q)
    arcs = []
    for p, (once, by) in enumerate(patterns):
        left, wide, cost = limit * sum(by.values()), once, 0
        while left > 0:  # once, once more, then bands twice as wide each
            net.add(start, p, min(left, wide), cost)
            left, wide, cost = left - wide, wide if not cost else 2 * wide, cost + REPEAT
        arcs.append({s: [net.add(p, k + s, n, c) for c in range(limit)] for s, n in by.items()})
    net.solve(start, end)
    return [{s: sum(map(net.flow, each)) for s, each in own.items()} for own in arcs]


def _cut(rows: DataFrame, by: Column, among: list[str]) -> DataFrame:
    """Of rows with size and left (words wanted of the group) the value of by in which the group's running sum reaches left, and what is left before it."""
    bins = rows.groupBy(*among, "left", by.alias("bin")).agg(F.sum("size").alias("here"))
    done = F.sum("here").over(W.partitionBy(*among).orderBy("bin"))
    return bins.withColumn("done", done).filter((F.col("done") >= F.col("left")) & (F.col("done") - F.col("here") < F.col("left"))).select(*among, F.col("bin"), (F.col("left") - F.col("done") + F.col("here")).alias("left"))


def _place(width: int, k: int) -> Column:
    """The k-th group of width bits of a hash of 63 bits, from the highest."""
    return F.shiftright("h", 63 - width * (k + 1)).bitwiseAND((1 << width) - 1)


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, limit: int = LIMIT, patterns: int = PATTERNS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, n_sources (that hold the text): one row per document. weights go to the sources by code point, repeating."""
    text, ident = F.col(text_col), F.col(id_col)
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    h = F.xxhash64(F.lit(SEED), ident.cast("string"), digest, text.isNull()).bitwiseAND((1 << 63) - 1)
    slim = docs.select(ident.alias("id"), F.col(source_col).alias("source"), words(text).alias("size"), F.unhex(digest).alias("d"), h.alias("h"))
    slim = written(spark, slim, "sizes")
    found = slim.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sources = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in sources]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, limit)
    table = [(k, r.source, r.n, float(g)) for k, (r, g) in enumerate(zip(sources, goals, strict=True))]
    named = spark.createDataFrame(table, "s int, name string, source_size long, target double")
    coded = written(spark, slim.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name"))).drop("name"), "coded")

    # a text that more than one document holds has a pattern; all others have their source's
    texts = coded.groupBy("d").agg(F.array_sort(F.collect_set("s")).alias("held"), F.count("*").alias("n"), F.first("size").alias("once")).filter("n > 1")
    texts = written(spark, texts, "texts")
    common = texts.filter((F.size("held") > 1) & (F.col("once") > 0)).groupBy("held").agg(F.sum(F.col("once") * F.col("n")).alias("all")).orderBy(F.desc("all"), "held").limit(patterns).collect()
    known = spark.createDataFrame([(r.held, k) for k, r in enumerate(common, len(sources))], "held array<int>, p int")
    placed = texts.join(F.broadcast(known), "held", "left").select("d", "n", F.size("held").alias("n_sources"), "p")
    slots = answered_or_not(coded, placed, "d", "n", coded.count())
    slots = written(spark, slots.withColumn("p", F.coalesce("p", "s")).withColumn("copies", F.coalesce("n", F.lit(1))).drop("n"), "slots")
    remove(spark, coded)
    remove(spark, slim)

    # words of a pattern's documents by source, and of its different texts: each text counts a copies-th part for each of its copies
    cells = slots.groupBy("p", "s").agg(F.sum("size").alias("n")).filter("n > 0").collect()
    per_text = slots.filter("size > 0").groupBy("p", "copies").agg(F.sum("size").alias("n")).groupBy("p").agg(F.sum(F.floor(F.col("n") / F.col("copies"))).alias("once")).collect()
    once = {r.p: max(1, r.once) for r in per_text}
    by: dict[int, dict[int, int]] = {}
    for r in sorted(cells, key=lambda r: (r.p, r.s)):
        by.setdefault(r.p, {})[r.s] = r.n
    quotas = [min(round(g), limit * n) for g, n in zip(goals, sizes, strict=True)]
    routed = route(quotas, [(once[p], own) for p, own in by.items()], limit)
    wanted = [(p, s, f // by[p][s], f % by[p][s]) for p, own in zip(by, routed, strict=True) for s, f in own.items()]

    # the rest: documents in order of h until it is reached; the place of the cut by histograms of its bits, then among the few of one place
    plan = spark.createDataFrame(wanted, "p int, s int, times long, left long")
    cut, near = plan.filter("left > 0").select("p", "s", "left"), slots.filter("size > 0").select("p", "s", "h", "size")
    for k in range(3):
        near = near.join(F.broadcast(cut), ["p", "s"])
        here = written(spark, _cut(near, _place(BINS, k) if k < 2 else F.col("h"), ["p", "s"]), "cut")  # at most one row a cell
        near = near.drop("left").join(F.broadcast(here.select("p", "s", "bin")), ["p", "s"]).filter((_place(BINS, k) if k < 2 else F.col("h")) == F.col("bin")).drop("bin")
        cut = here.select("p", "s", "left")
    last = written(spark, near.groupBy("p", "s", "h").agg(F.count("*").alias("rows")).join(F.broadcast(cut), ["p", "s"]).select("p", "s", F.col("h").alias("at"), F.floor(F.col("left") / F.col("rows")).alias("part")), "last")
    told = slots.join(F.broadcast(plan.select("p", "s", "times")), ["p", "s"], "left").join(F.broadcast(last), ["p", "s"], "left")
    more = F.when(F.col("h") < F.col("at"), F.col("size")).when(F.col("h") == F.col("at"), F.least("part", "size")).otherwise(0)
    taken = F.when(F.col("size") > 0, F.coalesce("times", F.lit(0)) * F.col("size") + more).otherwise(0).cast("long")
    return told.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", taken.alias("taken"), F.coalesce("n_sources", F.lit(1)).alias("n_sources"))
