"""Sources and evidence: quality, keep-best dedup, denylists, relevance, quotes, coverage, and the citation check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.functions import relevance as R
from corroborate.functions import text as T
from corroborate.functions import urls as U
from corroborate.operators.retrieval import small, spread
from corroborate.session import written

# Fixed values.
SPAM = ["click here", "subscribe to read", "unverified rumor"]
KNOWN_PROVIDERS = ["wikipedia", "local_rag", "mock"]
NOT_EXTRACTED = ["snippet", "crawl_failed", "empty"]
MIN_QUALITY = 0.35


def quality(title: Column, content: Column, url: Column, provider: Column) -> tuple[Column, Column]:
    """(score from 0 to 1, reasons)."""
    body = T.stripped(content)
    signals = [
        (F.length(T.stripped(title)) >= 4, 0.15, "has_title"),
        (F.length(body) >= 60, 0.25, "substantial_content"),
        (url.startswith("https://") | url.startswith("file://"), 0.15, "stable_url"),
        (provider.isin(KNOWN_PROVIDERS), 0.15, "known_adapter"),
        (content.rlike(r"\[[0-9]+\]"), 0.05, "contains_reference_marker"),
        (F.lower(content).rlike("|".join(SPAM)), -0.35, "low_quality_pattern"),
    ]
    score = F.lit(0.2)
    for holds, weight, _ in signals:
        score = score + F.when(holds, weight).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(holds, name) for holds, _, name in signals]))
    return F.round(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), 3), reasons


def verified(sources: DataFrame) -> DataFrame:
    """Sources (title, content, url, provider, score, ...) of enough quality, with quality_score and quality_reasons; callers order by them."""
    score, reasons = quality(*(F.col(c) for c in ("title", "content", "url", "provider")))
    return sources.withColumn("quality_score", score).withColumn("quality_reasons", reasons).filter(F.col("quality_score") >= MIN_QUALITY)


def worth() -> Column:
    return F.col("quality_score") * 10 + F.col("score")


def keep_best(sources: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Of sources with one dedup key the best, the first among equals. max_by combines map-side, so a key that many sources share costs one row a task."""
    keyed = sources.withColumn("dedup_key", U.dedup_key(F.col("url"), F.col("title")))
    best = keyed.groupBy("dedup_key").agg(F.max_by(F.struct(*sources.columns), F.struct(worth(), -F.col(ord_col))).alias("s"))
    return best.select("dedup_key", "s.*")


def numbered(sources: DataFrame, ord_col: str = "ord", by: list[str] | None = None) -> DataFrame:
    """Ids S1, S2, ... in order of worth, within each group of by (a run's sources)."""
    w = W.partitionBy(*(by or [])).orderBy(F.desc(worth()), ord_col)
    return sources.withColumn("source_id", F.concat(F.lit("S"), F.row_number().over(w)))


def citable(status: Column, snippet_only: Column, content: Column) -> Column:
    """P4."""
    return (T.stripped(F.coalesce(content, F.lit(""))) != "") & ~F.coalesce(snippet_only, F.lit(False)) & ~F.coalesce(status, F.lit("")).isin(NOT_EXTRACTED)


def evidence_ready(status: Column, snippet_only: Column, crawler: Column, provider: Column, blocked: Column) -> Column:
    """P5: neither blocked nor, in the gateway chain, without an extracted page."""
    fetched = (status == "ok") & ~F.coalesce(snippet_only, F.lit(True)) & (F.coalesce(crawler, F.lit("")) != "")
    return ~F.coalesce(blocked, F.lit(False)) & F.when(provider == "gateway-web", F.coalesce(fetched, F.lit(False))).otherwise(F.lit(True))


def _origin(c: str) -> Column:
    return F.concat_ws("|", f"{c}.scheme", f"{c}.host", F.coalesce(F.col(f"{c}.port").cast("string"), F.lit("")))


def denylisted(sources: DataFrame, blocked: DataFrame) -> DataFrame:
    """Sources with a column blocked; blocked has one url a row.

    A rule is a key of origin and path, or of origin and the folder of a blocked html report; a source has the key of its path and
    of each of its folders. Keys are hashes, met by an equi-join and then compared by their texts: an origin of many rules or
    many sources is no key, and no source is tested against all rules of its origin. Rules are broadcast within small()'s
    limit; beyond it the join shuffles the hashes, and Spark filters the sources' by a Bloom filter of the rules'."""
    key = lambda c, kind, path: F.struct(F.xxhash64(F.lit(kind), _origin(c), path).alias("h"), F.lit(kind).alias("kind"), path.alias("path"))
    deny = blocked.select(U.identity(F.col("url")).alias("b")).filter("b is not null").distinct()
    report = U.report_folder(F.col("b.path"))
    rules = deny.select(_origin("b").alias("origin"), F.inline(F.array(key("b", "page", F.col("b.path")), F.when(report.isNotNull(), key("b", "folder", report))))).filter("h is not null").distinct()
    s = sources.withColumn("__id", U.identity(F.col("url")))
    ids = s.select("__id").filter("__id is not null").distinct()
    folders = F.transform(U.folders(F.col("__id.path")), lambda p: key("__id", "folder", p))
    asked = ids.select("__id", F.inline(F.concat(F.array(key("__id", "page", F.col("__id.path"))), folders)))
    met = asked.join(small(rules.select(F.col("h").alias("rh"), F.col("kind").alias("rk"), F.col("path").alias("rp"), "origin")), F.col("h") == F.col("rh"))
    hits = met.filter((F.col("kind") == F.col("rk")) & (F.col("path") == F.col("rp")) & (_origin("__id") == F.col("origin"))).select(F.col("__id").alias("__hit")).distinct()
    hits = written(sources.sparkSession, hits, "blocked")
    told = s.join(small(hits), F.col("__id") == F.col("__hit"), "left")
    return told.withColumn("blocked", F.col("__hit").isNotNull() | F.coalesce(U.benchmark_url(F.col("url")), F.lit(False))).drop("__id", "__hit")


def contaminated_content(content: Column, query: Column) -> Column:
    """P10: the page holds the query, 16 characters or more, and the fields of an answer key."""
    q = T.squeezed(F.lower(query))
    return (F.length(q) >= 16) & T.squeezed(F.lower(content)).contains(q) & F.lower(content).rlike(f"(?i){U.ANSWER_FIELD}")


def best_quotes(pairs: DataFrame, keys: list[str], claim: str, title: str = "title", content: str = "content", max_chars: int = 280) -> DataFrame:
    """Pairs with a column best, struct(quote, score): the first passage of the highest score, '' and 0.0 where none is above 0.

    Passages are rows, so that the claim's features are worked out once a pair and the rest runs as generated code;
    the best of a pair is picked by max_by, which combines map-side. keys identify a pair and are not null."""
    c = F.col(claim)
    pairs = spread(pairs, keys)
    held = R.anchored(c, F.concat_ws(" ", title, content))
    once = pairs.filter(F.col(claim).isNotNull() & F.col(content).isNotNull()).select(*keys, R.claim_features(c).alias("f"), held.alias("held"), R.candidates(F.col(content), max_chars).alias("all"))
    rows = once.select(*keys, "f", "held", F.posexplode("all").alias("at", "quote"))
    seen = rows.withColumns(R.passage_features(F.col("quote")))
    scored = seen.select(*keys, "at", "quote", R.relevance(F.col("f"), F.col("held")).alias("score"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("quote", "score"), F.struct("score", -F.col("at"))).alias("best")).filter("best.score > 0")
    none = F.struct(F.lit("").alias("quote"), F.lit(0.0).alias("score"))
    return pairs.join(best, keys, "left").withColumn("best", F.coalesce("best", none))


def relevant(claim: Column, title: Column, content: Column, best: Column) -> Column:
    """Whether a source may be evidence for a claim; best is from best_quotes()."""
    low = F.lower(claim)
    needs = R.asks_time(low) | R.asks_founding(low)
    head = F.concat(title, F.lit(" "), best["quote"])
    return (best["quote"] != "") & (best["score"] >= R.min_overlap(claim)) & (~needs | R.anchored(claim, head)) & ((F.size(R.proper_names(claim)) == 0) | R.names_covered(claim, F.concat(title, F.lit(" "), content)))


def subquestion_relevant(question: Column, entities: Column, title: Column, content: Column, best: Column) -> Column:
    """P6, or, where entities are required, a good quote and any entity covered."""
    covered = F.exists(entities, lambda e: covers_entity(title, content, best["quote"], e, True))
    return relevant(question, title, content, best) | ((F.size(entities) > 0) & (best["quote"] != "") & (best["score"] >= R.min_overlap(question)) & covered)


def covers_entity(title: Column, content: Column, quote: Column, entity: Column, substantive: bool) -> Column:
    return R.covers_term(title, entity) | R.covers_term(quote, entity) | R.covers_term(content, entity, 2 if substantive else 1)


def coverage_status(pairs: DataFrame) -> DataFrame:
    """Of rows (question_id, title, content, quote, entities, aspects), a source each, per question what is covered and missing."""
    by_entity = F.transform("entities", lambda e: covers_entity(F.col("title"), F.col("content"), F.col("quote"), e, True))
    whole = F.concat_ws(" ", "title", "content", "quote")
    by_aspect = F.transform("aspects", lambda a: R.covers_term(whole, a))
    told = pairs.select("question_id", F.array_distinct("entities").alias("entities"), F.array_distinct("aspects").alias("aspects"), "title", "content", "quote").select(
        "question_id", "entities", "aspects", F.filter(F.zip_with("entities", by_entity, lambda e, c: F.when(c, e)), lambda e: e.isNotNull()).alias("ce"), F.filter(F.zip_with("aspects", by_aspect, lambda a, c: F.when(c, a)), lambda a: a.isNotNull()).alias("ca")
    )
    g = told.groupBy("question_id", "entities", "aspects").agg(F.array_distinct(F.flatten(F.collect_set("ce"))).alias("ce"), F.array_distinct(F.flatten(F.collect_set("ca"))).alias("ca"))
    g = g.select("question_id", F.array_intersect("entities", "ce").alias("covered_entities"), F.array_except("entities", "ce").alias("missing_entities"), F.array_intersect("aspects", "ca").alias("covered_aspects"), F.array_except("aspects", "ca").alias("missing_aspects"))
    complete = (F.size("missing_entities") == 0) & (F.size("missing_aspects") == 0)
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), F.array_join(c, ", ")))
    gap = F.concat(F.lit("missing required coverage: "), F.concat_ws("; ", part("entities", "missing_entities"), part("aspects", "missing_aspects")))
    follow = F.concat_ws(" ", F.concat("missing_entities", "missing_aspects", F.array(F.lit("official primary source"))))
    return g.withColumn("complete", complete).withColumn("gap", F.when(~complete, gap)).withColumn("follow_up", F.when(~complete, follow))


def evidence_items(pairs: DataFrame) -> DataFrame:
    """Z3: of rows (question_id, question, entities, source_id, title, url, content, extract_status, snippet_only) the evidence: question_id, source_id, quote, overlap_score."""
    scored = best_quotes(pairs.filter(citable(F.col("extract_status"), F.col("snippet_only"), F.col("content"))), ["question_id", "source_id"], "question")
    kept = scored.filter(subquestion_relevant(F.col("question"), F.col("entities"), F.col("title"), F.col("content"), F.col("best")))
    return kept.select("question_id", "source_id", F.col("best.quote").alias("quote"), F.round("best.score", 3).alias("overlap_score"))


def citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per citation in claims (report_id, ord, claim), joined with sources (report_id, source_id, title, content, extract_status, snippet_only).

    Claims without citation stay, with a null source_id. The best quote is computed once per citation."""
    refs = claims.select("report_id", "ord", "claim", F.posexplode_outer(T.extract_all(F.col("claim"), R.CITATION, 1)).alias("pos", "source_id"))
    s = sources.select("report_id", "source_id", "title", "content", "extract_status", "snippet_only", F.lit(True).alias("known"))
    joined = refs.join(s, ["report_id", "source_id"], "left").withColumn("pos", F.coalesce("pos", F.lit(0)))
    joined = best_quotes(joined, ["report_id", "ord", "pos"], "claim")
    snippet = F.coalesce("snippet_only", F.lit(False)) | F.coalesce("extract_status", F.lit("")).isin(NOT_EXTRACTED)
    return joined.select("report_id", "ord", "claim", "source_id", (F.col("source_id").isNotNull() & F.col("known").isNull()).alias("missing"), (F.col("known").isNotNull() & snippet).alias("snippet"), F.col("best.quote").alias("quote"), F.col("best.score").alias("overlap"))


def assessments(refs: DataFrame) -> DataFrame:
    """P14 over citations(): one row per claim with its support level, best overlap and quotes."""
    cited = F.col("source_id").isNotNull()
    ok = cited & ~F.col("missing") & ~F.col("snippet") & (F.col("quote") != "") & (F.col("overlap") >= R.min_overlap(F.col("claim")))
    g = refs.groupBy("report_id", "ord", "claim").agg(
        F.count_if(cited).alias("n_cited"),
        F.count_if("missing").alias("n_missing"),
        F.count_if("snippet").alias("n_snippet"),
        F.coalesce(F.max("overlap"), F.lit(0.0)).alias("best_overlap"),
        F.max(F.when(F.col("quote") != "", F.col("overlap"))).alias("quote_overlap"),
        F.count_if(ok).alias("n_supporting"),
    )
    level = R.support_level(F.col("n_cited"), F.col("n_missing"), F.col("n_snippet"), F.col("best_overlap"), R.min_overlap(F.col("claim")))
    return g.withColumn("support_level", level).withColumn("supported", level == "supported")


def judged(claims: DataFrame) -> DataFrame:
    """assessments() with the heuristic judge on top; where the structure blocks a claim its level stays and it is not supported."""
    verdict = R.heuristic_judgment(F.col("quote_overlap"))
    block = (F.col("n_missing") > 0) | F.col("quote_overlap").isNull() | (F.col("n_snippet") == F.col("n_cited"))
    return claims.withColumn("supported", ~block & (verdict == "supported")).withColumn("support_level", F.when(block, F.col("support_level")).otherwise(verdict))


def citation_report(claims: DataFrame) -> DataFrame:
    """A1: per report, from assessments() or judged(), counts and rates; precision is over references."""
    rate = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    total, good = F.count("*"), F.count_if("supported")
    return claims.groupBy("report_id").agg(
        total.alias("total_claims"),
        good.alias("supported_claims"),
        (total - good).alias("unsupported_claims"),
        rate(good, total).alias("retention_rate"),
        rate(good, total).alias("citation_grounding"),
        rate(F.count_if(F.col("n_cited") > F.col("n_missing")), total).alias("citation_coverage"),
        rate(total - good, total).alias("unsupported_claim_rate"),
        rate(F.sum("n_supporting"), F.sum("n_cited")).alias("citation_precision"),
        (total > 0).alias("claim_extraction_valid"),
    )


def diversity(sources: DataFrame, by: list[str]) -> DataFrame:
    """A5: per group the distinct providers and domains and their sorted counts."""
    tall = sources.select(*by, F.explode(F.array(F.struct(F.lit("provider").alias("kind"), F.coalesce(F.nullif(F.col("provider"), F.lit("")), F.lit("unknown")).alias("name")), F.struct(F.lit("domain").alias("kind"), U.domain(F.col("url")).alias("name")))).alias("x")).select(*by, "x.*")
    counts = tall.groupBy(*by, "kind", "name").agg(F.count("*").alias("n"))
    pairs = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n"))))
    g = counts.groupBy(*by).agg(pairs("provider").alias("p"), pairs("domain").alias("d"))
    return g.select(*by, F.size("p").alias("source_provider_count"), F.size("d").alias("source_domain_count"), F.map_from_entries("p").alias("source_provider_counts"), F.map_from_entries("d").alias("source_domain_counts"))


def prompt_leaks(docs: DataFrame, prompts: DataFrame, answer_fields: bool = True) -> DataFrame:
    """P10 as a join: (doc_id, item_id) where docs (doc_id, text) hold the prompt of prompts (item_id, text).

    A prompt inside a page holds all its words but the first and the last as whole words there, so the pairs come from an
    equi-join on three neighbouring ones of them (those with the most characters, as these are rarest), or on the two or the one
    of shorter prompts. Of prompts of one or two words the page may hold more on either side; they come from an equi-join on their
    first 16 characters, which any place of the page may begin. Keys are hashes and travel with the doc_id alone; the texts of the
    documents that have a candidate are joined once, and there the whole prompt decides."""
    p = prompts.select("item_id", T.squeezed(F.lower("text")).alias("q")).filter(F.length("q") >= 16).withColumn("w", F.split("q", " "))
    d = docs.select("doc_id", T.squeezed(F.lower("text")).alias("t"), F.lower("text").rlike(f"(?i){U.ANSWER_FIELD}").alias("fields"))
    d = d.filter("fields") if answer_fields else d
    words = d.select("doc_id", F.split("t", " ").alias("w"))
    run = lambda n: lambda k: F.array_join(F.slice("w", k, n), " ")
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), run(n))).otherwise(F.array().cast("array<string>"))
    hashed = lambda c: F.array_distinct(F.transform(c, lambda x: F.xxhash64(x)))
    inner = F.transform(F.sequence(F.lit(2), F.size("w") - 3), lambda k: F.struct(F.length(run(3)(k)).alias("n"), run(3)(k).alias("r")))
    kinds = (
        (p.filter(F.size("w") >= 5), F.array_max(inner)["r"], words, runs(3)),
        (p.filter(F.size("w").isin(3, 4)), F.array_join(F.slice("w", F.lit(2), F.size("w") - 2), " "), words, F.concat(runs(1), runs(2))),
        (p.filter(F.size("w") <= 2), F.substr("q", F.lit(1), F.lit(16)), d.filter(F.length("t") >= 16), F.transform(F.sequence(F.lit(1), F.length("t") - 15), lambda k: F.substr("t", k, F.lit(16)))),
    )
    pairs = None
    for some, key, held, keys in kinds:
        asked = some.select("item_id", F.xxhash64(key).alias("key"))
        if not asked.isEmpty():
            met = held.select("doc_id", F.explode(hashed(keys)).alias("key")).join(small(asked), "key").select("doc_id", "item_id").distinct()
            pairs = met if pairs is None else pairs.unionByName(met)
    if pairs is None:
        return d.select("doc_id").join(p.select("item_id").limit(0))
    pairs = written(docs.sparkSession, pairs.select(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i")).join(small(p.select(F.col("item_id").alias("__i"), "q")), "__i"), "candidates")
    found = d.join(small(pairs), F.col("doc_id").eqNullSafe(F.col("__d"))).filter(F.col("t").contains(F.col("q")))
    return found.select("doc_id", F.col("__i").alias("item_id")).distinct()


def evidence_summaries(items: DataFrame, rounds: DataFrame) -> DataFrame:
    """Per question a sentence on its evidence (question_id, ord, title, quote) and its rounds (question_id, n_rounds), with the first three quotes."""
    g = items.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.col("title"), F.lit(": "), F.col("quote")).alias("x")))).alias("e"))
    first = F.array_join(F.transform(F.slice("e", 1, 3), lambda x: x["x"]), " | ")
    found = F.concat(F.lit("Collected "), F.size("e").cast("string"), F.lit(" verified evidence items across "), F.col("n_rounds").cast("string"), F.lit(" bounded research rounds. Evidence: "), first)
    j = rounds.join(g, "question_id", "left")
    return j.select("question_id", F.when(F.size(F.coalesce("e", F.array().cast("array<struct<ord:int,x:string>>"))) > 0, found).otherwise("No verified evidence survived filtering for this subquestion.").alias("summary"))


def compressed(findings: DataFrame, limit: int = 1200) -> DataFrame:
    """Per run its findings (run_id, q, summary, titles) as lines, cut at limit."""
    titles = F.coalesce(F.nullif(F.array_join(F.slice(F.array_distinct("titles"), 1, 3), ", "), F.lit("")), F.lit("no sources"))
    line = F.concat(F.col("q"), F.lit(": "), F.col("summary"), F.lit(" Sources: "), titles)
    g = findings.select("run_id", "q", line.alias("line")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("q", "line"))).alias("f"))
    return g.select("run_id", F.regexp_replace(F.substr(F.array_join(F.transform("f", lambda x: x["line"]), "\n"), F.lit(1), F.lit(limit)), r"\s+$", "").alias("text"))


def claims_of_payload(payload: Column) -> Column:
    """The claims of a model's JSON under any of their names: texts as they are, objects as `text [ids]`, each id once."""
    kind = "array<struct<text:string,claim:string,citations:array<string>>>"
    texts = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{n}"), "array<string>") for n in ("claims", "claim_items", "key_claims", "factual_claims")])
    objects = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{n}"), kind) for n in ("claims", "claim_items", "key_claims", "factual_claims")])
    body = lambda o: F.coalesce(o["text"], o["claim"], F.lit(""))
    ids = lambda o: F.array_join(F.transform(F.filter(F.coalesce(o["citations"], F.array().cast("array<string>")), lambda c: ~body(o).contains(F.concat(F.lit("["), c, F.lit("]")))), lambda c: F.concat(F.lit(" ["), c, F.lit("]"))), "")
    from_objects = F.transform(objects, lambda o: F.concat(body(o), ids(o)))
    shaped = F.exists(texts, lambda t: F.trim(t).startswith("{"))
    return F.array_distinct(F.filter(F.when(shaped, from_objects).otherwise(texts), lambda c: T.stripped(c) != ""))
