"""How well a passage answers a claim: overlap, anchors, and the relevance score of quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corroborate.functions import text as T

# Fixed values.
STOPWORDS = ["a", "an", "and", "are", "as", "by", "for", "from", "in", "is", "it", "of", "or", "the", "this", "to", "with"]
GENERIC = [
    "what", "when", "where", "who", "why", "how", "which", "is", "are", "was", "were", "the", "a", "an", "of", "for", "to", "in", "on", "at", "as", "and", "or", "year",
    "date", "officially", "recorded", "founded", "founding", "foundation", "established", "municipality", "city", "town", "country", "answer", "source", "sources",
    "evidence", "历史", "资料", "来源", "证据", "什么", "何时", "哪年", "哪一年", "年份", "日期", "成立", "创立", "建于", "城市", "市", "镇", "国家",
]
COVERAGE_STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "of", "on", "or", "the", "to", "with"]
PROPER_NAME = r"\b(?:[A-Z][a-z]{2,}|[A-Z][A-Z0-9-]{1,})\b"
NAME_PHRASE = r"\b(?:[A-Z][a-z]{2,}|[A-Z][A-Z0-9-]{1,})(?:\s+(?:[A-Z][a-z]{2,}|[A-Z][A-Z0-9-]{1,}))+\b"
VERSION = r"\b\d+\.\d+(?:\.\d+)?(?:[-_a-z0-9.]*)\b"
ASKS_TIME = r"\b(?:when|what\s+(?:year|date|month)|which\s+year|year|date)\b|(?:何时|哪年|哪一年|年份|日期|时间|何月|几月)"
HAS_DATE = (
    r"\b(?:1[5-9]\d{2}|20\d{2})\b|\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|"
    r"sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?\s+\d{1,2}"
)
ASKS_FOUNDING = r"\b(?:founded|founding|foundation|established)\b|(?:建市|成立|创立|建于)|fundaci"
SAYS_FOUNDING = r"\b(?:founded|founding|established|officially\s+started|was\s+started|created)\b|fundaci|成立|创立|建于"
CITATION = r"\[([SR]\d+)\]"
MIN_OVERLAP = 0.08
CJK_MIN_OVERLAP = 0.18


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def content_tokens(text: Column) -> Column:
    return F.array_except(T.tokens(text), _words(STOPWORDS))


def claim_tokens(claim: Column) -> Column:
    """The tokens of a claim without its citation marks and stop words."""
    return content_tokens(F.regexp_replace(claim, r"\[[SR]\d+\]", " "))


def overlap(claim: Column, passage: Column) -> Column:
    """The share of the claim's tokens that the passage has."""
    return shared(claim_tokens(claim), content_tokens(passage))


def shared(claim: Column, passage: Column) -> Column:
    """overlap() of a claim's and a passage's tokens."""
    return F.when(F.size(claim) == 0, 0.0).otherwise(F.size(F.array_intersect(claim, passage)) / F.size(claim))


def min_overlap(claim: Column) -> Column:
    """Claims in CJK need more."""
    return F.when(claim.rlike(T.CJK), CJK_MIN_OVERLAP).otherwise(MIN_OVERLAP)


def asks_time(lowered: Column) -> Column:
    return lowered.rlike(ASKS_TIME)


def asks_founding(lowered: Column) -> Column:
    return lowered.rlike(ASKS_FOUNDING)


def proper_names(claim: Column) -> Column:
    """Lower-cased capitalised words and acronyms, without stop and generic words."""
    found = F.transform(T.extract_all(claim, PROPER_NAME), lambda w: F.lower(w))
    return F.array_except(F.array_distinct(found), _words(STOPWORDS + GENERIC))


def name_phrases(claim: Column) -> Column:
    """Runs of two or more capitalised words, lower-cased."""
    return F.transform(T.extract_all(claim, NAME_PHRASE), lambda p: F.array_join(T.extract_all(F.lower(p), "[a-z0-9-]+"), " "))


def query_anchors(claim: Column) -> Column:
    """Tokens that are specific: neither stop nor generic words, of three or more letters or CJK."""
    return F.filter(F.array_except(T.tokens(claim), _words(STOPWORDS + GENERIC)), lambda t: (F.length(t) > 2) | t.rlike(r"[㐀-鿿]"))


def _enough(anchors: Column, candidate: Column) -> Column:
    return F.size(F.array_intersect(anchors, T.tokens(candidate))) >= F.least(F.size(anchors), F.lit(2))


def anchored(claim: Column, candidate: Column) -> Column:
    """Two of the claim's anchors are in the candidate, or the one it has; true without anchors."""
    return _enough(query_anchors(claim), candidate)


def names_covered(claim: Column, candidate: Column) -> Column:
    """The same for proper names; a whole phrase of names is enough too."""
    spaced = F.array_join(T.extract_all(F.lower(candidate), "[a-z0-9-]+"), " ")
    return _enough(proper_names(claim), candidate) | F.exists(name_phrases(claim), lambda p: spaced.contains(p))


def claim_features(claim: Column) -> Column:
    """What relevance() needs of a claim, to be computed once for all passages."""
    low = F.lower(claim)
    return F.struct(
        claim_tokens(claim).alias("tokens"),
        query_anchors(claim).alias("anchors"),
        T.extract_all(low, VERSION).alias("versions"),
        asks_time(low).alias("time"),
        asks_founding(low).alias("founding"),
        low.contains("latest").alias("latest"),
        low.rlike("version|release|版本|发布").alias("release"),
    )


def passage_features(passage: Column) -> dict[str, Column]:
    """What relevance() needs of a passage, to be made columns of these names first: each is used more than once."""
    low = F.lower(passage)
    return {
        "p_all": T.tokens(passage),
        "p_versions": T.extract_all(low, VERSION),
        "p_flags": F.array(low.contains("latest"), low.rlike(HAS_DATE), low.rlike(SAYS_FOUNDING), passage.contains(">>>") | passage.contains("Traceback (most recent call last)")),
    }


def relevance(claim: Column, document_anchored: Column) -> Column:
    """Of claim_features() and the columns of passage_features(), the share of shared tokens, moved by versions, dates and founding words; 0 where the claim needs an anchor that is nowhere."""
    tokens, found, given = claim["tokens"], F.col("p_all"), F.col("p_versions")
    latest, dated, founded, traced = (F.col("p_flags")[k] for k in range(4))
    n = F.size(tokens)
    shared = F.size(F.array_intersect(tokens, found))  # a claim's tokens hold no stop word, so the passage's stop words cannot count
    held = document_anchored | (F.size(F.array_intersect(claim["anchors"], found)) >= F.least(F.size(claim["anchors"]), F.lit(2)))
    versions = F.when(F.size(claim["versions"]) == 0, 0.0).when(F.size(F.array_except(claim["versions"], given)) == 0, 0.4).when(F.size(given) > 0, -0.15).otherwise(0.0)
    add = lambda condition, value: F.when(condition, value).otherwise(0.0)
    score = (
        shared / n
        + versions
        + add(claim["latest"] & latest, 0.3)
        + add(claim["release"] & (F.size(given) > 0), 0.25)
        + add(claim["time"] & dated & held, 0.45)
        + add(claim["founding"] & founded & held, 0.3)
        + add(traced, -0.2)
    )
    bare = F.size(F.array_except(found, _words(STOPWORDS))) == 0
    return F.when((n == 0) | ((claim["time"] | claim["founding"]) & ~held) | bare, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))))


def candidates(content: Column, max_chars: int = 280) -> Column:
    """The evidence windows of all sentences, in order."""
    return F.flatten(F.transform(T.sentences(content), lambda s: T.evidence_windows(s, max_chars)))


def covers_term(text: Column, term: Column, least: int = 1) -> Column:
    """Every specific token of the term occurs in the text, least times at least."""
    needed = F.array_except(T.tokens(term), _words(COVERAGE_STOPWORDS))
    lowered = F.lower(text)
    stream = T.extract_all(lowered, r"[a-z0-9]+(?:[-_.][a-z0-9]+)*|[㐀-鿿]")
    pair = lambda t: (F.length(t) > 1) & t.rlike(r"[㐀-鿿]")
    direct = lambda t: (F.length(lowered) - F.length(F.replace(lowered, t, F.lit("")))) / F.length(t)
    count = lambda t: F.when(pair(t), direct(t)).otherwise(F.size(F.filter(stream, lambda w: w == t)))
    return (F.size(needed) > 0) & F.forall(needed, lambda t: count(t) >= least)


def support_level(cited: Column, missing: Column, snippets: Column, best: Column, threshold: Column) -> Column:
    """From the numbers of citations, missing and snippet-only ones, the best overlap and its threshold."""
    return (
        F.when(cited == 0, "unsupported")
        .when(missing == cited, "unverifiable")
        .when(missing > 0, F.when(best >= threshold, "partial").otherwise("unverifiable"))
        .when(snippets == cited, "unverifiable")
        .when((snippets > 0) & (best >= threshold), "partial")
        .when(best >= threshold, "supported")
        .when(best > 0, "partial")
        .otherwise("unsupported")
    )


def heuristic_judgment(best_overlap: Column) -> Column:
    """The verdict on a claim from the best overlap of its quotes, null where it has none."""
    return F.when(best_overlap.isNull(), "unverifiable").when(best_overlap >= 0.45, "supported").when(best_overlap >= 0.18, "partial").otherwise("unsupported")
