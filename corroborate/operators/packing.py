"""Packing of sources into a token budget: excerpts per source, then a greedy pass that skips what does not fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corroborate.functions import text as T
from corroborate.functions import urls as U
from corroborate.operators.retrieval import small, spread
from corroborate.session import written


PART = "at", "bonus", "p", "flagged", "n", "cost", "words"


def _parts(rows: DataFrame, keep: list[str], bonus: int, first: Column) -> DataFrame:
    """Of rows (keep, at, x: a piece of text) what does not depend on the question: the piece sanitised, its tokens and its price."""
    clean, flagged = T.sanitised_parts(F.col("x"))
    done = rows.select(*keep, (F.col("at") + first).alias("at"), F.lit(bonus).alias("bonus"), clean.alias("p"), flagged.alias("flagged"))
    return done.select(*keep, "at", "bonus", "p", "flagged", F.length("p").alias("n"), T.context_tokens(F.col("p")).alias("cost"), T.tokens(F.col("p")).alias("words"))


def excerpts(sources: DataFrame, keys: list[str], token_limit: int = 1200, at_most: int = 4, content_key: str | None = None) -> DataFrame:
    """Of rows (keys, content, terms, quotes) per key the best passages and quotes that fit: excerpt, relevance, flagged.

    content_key: a column whose value decides the content. Many questions ask about one source, so its passages are cut, sanitised
    and tokenised once for each value, and only then met with the questions. Passages are rows while they are scored; a source's
    few dozen scored passages are then one array that is folded."""
    asked = sources if content_key else sources.withColumn("__c", F.xxhash64("content"))
    by = content_key or "__c"
    contents = spread(asked.groupBy(by).agg(F.first("content").alias("content")), [by])
    passages = _parts(contents.select(by, F.posexplode(T.passages(F.col("content"))).alias("at", "x")), [by], 0, F.lit(0))
    one = written(sources.sparkSession, passages.groupBy(by).agg(F.collect_list(F.struct(*PART)).alias("parts")), "passages")
    of_source = asked.select(*keys, "terms", F.size("quotes").alias("q"), F.col(by).alias("__by")).join(small(one.withColumnRenamed(by, "__by")), "__by")
    of_source = of_source.select(*keys, "terms", "q", F.explode("parts").alias("x")).select(*keys, "terms", (F.col("x.at") + F.col("q")).alias("at"), *[f"x.{c}" for c in PART[1:]])
    quoted = _parts(asked.select(*keys, "terms", F.posexplode("quotes").alias("at", "x")), [*keys, "terms"], 100, F.lit(0))
    rows = spread(of_source.unionByName(quoted), keys)
    # an empty passage gets a score below all others
    score = F.when(F.col("p") == "", -1).otherwise(F.col("bonus") + F.size(F.array_intersect("terms", "words")))
    scored = rows.select(*keys, score.alias("points"), "n", "at", "p", "flagged", "cost")
    order = lambda a, b: F.when(a["points"] != b["points"], b["points"] - a["points"]).when(a["n"] != b["n"], b["n"] - a["n"]).otherwise(a["at"] - b["at"])
    g = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("points", "n", "at", "p", "flagged", "cost")), order).alias("all"))
    empty = F.array().cast("array<string>")
    begin = F.struct(empty.alias("kept"), F.lit(0).alias("used"), F.lit(False).alias("flagged"), F.lit(False).alias("done"))

    def add(acc: Column, x: Column) -> Column:
        first = F.size(acc["kept"]) == 0
        big = first & (x["cost"] > token_limit)
        p = F.when(big, T.truncated(x["p"], token_limit)).otherwise(x["p"])
        cost = F.when(big, token_limit).otherwise(x["cost"])
        skip = acc["done"] | (x["points"] < 0) | F.array_contains(acc["kept"], x["p"]) | (~first & (acc["used"] + x["cost"] > token_limit))
        used, kept = acc["used"] + cost, F.concat(acc["kept"], F.array(p))
        return F.when(skip, acc).otherwise(F.struct(kept.alias("kept"), used.alias("used"), (acc["flagged"] | x["flagged"]).alias("flagged"), ((used >= token_limit) | (F.size(kept) >= at_most)).alias("done")))

    folded = g.select(*keys, F.aggregate("all", begin, add).alias("r"), F.get("all", 0)["points"].alias("relevance"))
    return folded.select(*keys, F.array_join("r.kept", "\n\n").alias("excerpt"), F.greatest(F.col("relevance"), F.lit(0)).cast("double").alias("relevance"), F.col("r.flagged").alias("flagged"))


def pack(candidates: DataFrame, available: int = 8500, max_sources: int = 18, max_per_domain: int = 2) -> DataFrame:
    """Of rows (query_id, source_id, title, url, provider, quality_score, score, excerpt, relevance, has_evidence), per query the sources that a greedy pass keeps.

    Order: 20 for evidence + relevance + 4 quality + 0.05 score, then quality, then the larger source_id. A source whose
    domain is full, or that would exceed the budget, is skipped and the pass goes on. An item's price is that of its
    JSON. A query's candidates are few, so the pass is a fold over one array."""
    item = F.to_json(F.struct(F.col("source_id").alias("id"), "title", F.col("url"), "provider", "quality_score", F.lit(True).alias("untrusted_external_content"), "excerpt"))
    rank = F.when(F.col("has_evidence"), 20.0).otherwise(0.0) + F.col("relevance") + F.col("quality_score") * 4 + F.col("score") * 0.05
    domain = F.lower(F.coalesce(F.nullif(U.host(F.col("url")), F.lit("")), F.nullif(F.col("provider"), F.lit("")), F.lit("unknown")))
    rows = candidates.filter("excerpt <> ''").select("query_id", F.struct(rank.alias("rank"), "quality_score", "source_id", domain.alias("domain"), T.context_tokens(item).alias("cost")).alias("x"))
    g = rows.groupBy("query_id").agg(F.sort_array(F.collect_list("x"), asc=False).alias("all"))
    kept0 = F.array().cast("array<struct<id:string,domain:string>>")
    begin = F.struct(kept0.alias("kept"), F.lit(0).alias("used"))

    def add(acc: Column, x: Column) -> Column:
        same = F.size(F.filter(acc["kept"], lambda k: k["domain"] == x["domain"]))
        skip = (F.size(acc["kept"]) >= max_sources) | (same >= max_per_domain) | (acc["used"] + x["cost"] > available)
        more = F.struct(F.concat(acc["kept"], F.array(F.struct(x["source_id"].cast("string").alias("id"), x["domain"].alias("domain")))).alias("kept"), (acc["used"] + x["cost"]).alias("used"))
        return F.when(skip, acc).otherwise(more)

    folded = g.select("query_id", F.aggregate("all", begin, add).alias("r"), F.transform("all", lambda x: x["source_id"].cast("string")).alias("ids"))
    kept = F.transform("r.kept", lambda k: k["id"])
    return folded.select("query_id", kept.alias("kept_source_ids"), F.array_sort(F.array_except("ids", kept)).alias("dropped_source_ids"), F.col("r.used").alias("estimated_tokens"))
