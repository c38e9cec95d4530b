"""Judges: the heuristic answer judge, rubrics, merges of two judges with fixed denominators, stratified samples."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corroborate.functions import text as T

# How an answer says that it has none.
ABSTENTIONS = ["available sources are insufficient to support", "available evidence is insufficient to support", "现有来源不足以形成", "现有来源不足以支持", "现有检索结果不足以形成"]
VERDICTS = ["correct", "incorrect", "not_attempted", "unscored"]


def truth_groups(json: Column) -> Column:
    """Ground truth as array<array<string>>: a JSON string or list of strings are groups of one, a list of lists stays."""
    nested = F.from_json(json, "array<array<string>>")
    flat = F.from_json(json, "array<string>")
    alone = F.when(F.trim(json).startswith("["), F.lit(None)).otherwise(F.array(F.array(F.regexp_replace(json, '^"|"$', ""))))
    inner = F.exists(flat, lambda x: x.startswith("["))
    return F.coalesce(F.when(F.trim(json) == "", F.array().cast("array<array<string>>")), F.when(inner, nested), F.transform(flat, lambda x: F.array(x)), alone, F.array().cast("array<array<string>>"))


def abstains(answer: Column, normal: Column) -> Column:
    marked = normal.rlike("|".join(ABSTENTIONS))
    parsed = F.try_parse_json(answer)
    empty = answer.contains("claims") & F.coalesce((F.try_variant_get(parsed, "$.claims", "string") == "[]") & F.try_variant_get(parsed, "$.limitations", "string").isNotNull(), F.lit(False))
    return (normal == "") & (T.stripped(answer) == "") | marked | empty


def judged_answers(rows: DataFrame, answer: str, truth: str) -> DataFrame:
    """Rows with a verdict: correct if every group of the JSON truth has a normalised string in the answer.

    The answer's normal form is a column of its own: inside the tests of the groups it would be worked out once for each string."""
    normal = rows.withColumns({"__answer": T.normalised_answer(F.col(answer)), "__groups": F.transform(truth_groups(F.col(truth)), lambda g: F.filter(F.transform(g, lambda s: T.normalised_answer(s)), lambda s: s != ""))})
    a, groups = F.col("__answer"), F.col("__groups")
    every = F.forall(groups, lambda g: F.exists(g, lambda s: a.contains(s)))
    verdict = F.when(F.size(groups) == 0, "unscored").when(abstains(F.col(answer), a), "not_attempted").when(every, "correct").otherwise("incorrect")
    return normal.withColumn("verdict", verdict).drop("__answer", "__groups")


def contract(verdict: Column, score: Column, confidence: Column, missing: Column, errors: Column) -> Column:
    """The verdict, or unscored where the judgment contradicts itself or lacks a sound confidence."""
    v = F.lower(F.trim(verdict))
    sound = v.isin(VERDICTS[:3]) & confidence.between(0.0, 1.0) & (score.isNull() | score.between(0.0, 1.0))
    right = F.when(v == "correct", (F.coalesce(score, F.lit(1.0)) == 1.0) & (F.size(missing) == 0) & (F.size(errors) == 0)).otherwise(F.coalesce(score, F.lit(0.0)) < 1.0)
    return F.when(F.coalesce(sound & right, F.lit(False)), v).otherwise("unscored")


def explode_rubrics(specs: DataFrame) -> DataFrame:
    """Rows (id, info_recall, analysis, presentation) as one rubric a row: case_id, category, rubric_index, text, rubric_id, rubric_sha256."""
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("texts")) for c in ("info_recall", "analysis", "presentation")])
    rows = specs.select(F.col("id").alias("case_id"), F.explode(kinds).alias("k")).select("case_id", "k.category", F.posexplode("k.texts").alias("rubric_index", "text"))
    return rows.select("case_id", "category", "rubric_index", "text", F.concat_ws(":", "case_id", "category", F.col("rubric_index").cast("string")).alias("rubric_id"), F.sha2(T.stripped(F.col("text")), 256).alias("rubric_sha256"))


def latest(judgments: DataFrame, key: str = "rubric_id", attempt: str = "attempt") -> DataFrame:
    """The highest attempt of each key; repeated attempts are an error."""
    best = judgments.groupBy(key).agg(F.max_by(F.struct(*judgments.columns), attempt).alias("j"), F.count("*").alias("n"), F.count_distinct(attempt).alias("d"))
    ok = F.when(F.col("n") == F.col("d"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("attempts repeat for "), F.col(key).cast("string"))).cast("boolean"))
    return best.filter(ok).select("j.*")


def pending(specs: DataFrame, judged: DataFrame, key: str = "rubric_id", retry: bool = True) -> DataFrame:
    """K7: the specs without a judgment, or, when retrying, with an unscored one."""
    done = judged.filter("score <> -1") if retry else judged
    return specs.join(done.select(key), key, "left_anti")


def batches(rows: DataFrame, by: str, order: str, size: int = 50) -> DataFrame:
    """A batch number for each row, size rows a batch within by."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(by).orderBy(order)) - 1) / size).cast("int"))


def merge_two(specs: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Specs with both judges' (key, score, self_judge); a missing row is unscored (-1), so no denominator shrinks."""
    side = lambda df, n: df.select(key, F.col("score").alias(f"score_{n}"), F.col("self_judge").alias(f"self_{n}"))
    m = specs.join(side(a, "a"), key, "left").join(side(b, "b"), key, "left").withColumns({f"score_{n}": F.coalesce(f"score_{n}", F.lit(-1)) for n in "ab"})
    scored = F.col("score_a").isin(0, 1) & F.col("score_b").isin(0, 1)
    both = (F.col("score_a") == 1) & (F.col("score_b") == 1)
    alien = (F.coalesce("self_a", F.lit(True)) == False) & (F.coalesce("self_b", F.lit(True)) == False)  # noqa: E712
    return m.withColumns(
        {"agreement": scored & (F.col("score_a") == F.col("score_b")), "disagreement": scored & (F.col("score_a") != F.col("score_b")), "unscored": ~scored, "conservative_pass": both, "independent_pass": both & alien, "any_self_judge": F.coalesce("self_a", F.lit(False)) | F.coalesce("self_b", F.lit(False))}
    )


def audit_rubrics(merged: DataFrame, category: str = "category", case: str = "case_id") -> DataFrame:
    """Total, by category and by case, as grouping sets of one aggregation."""
    n = F.count("*")
    rate = lambda c: F.round(c / n, 4)
    cols = []
    for s in "ab":
        one, zero = F.count_if(F.col(f"score_{s}") == 1), F.count_if(F.col(f"score_{s}") == 0)
        cols += [one.alias(f"ones_{s}"), zero.alias(f"zeros_{s}"), (n - one - zero).alias(f"unscored_{s}"), rate(one).alias(f"rate_fixed_{s}"), F.when(one + zero > 0, F.round(one / (one + zero), 4)).alias(f"rate_scored_{s}")]
    flags = ("agreement", "disagreement", "unscored", "conservative_pass", "independent_pass")
    sets = [[F.col(category)], [F.col(case)], []]
    return merged.groupingSets(sets, category, case).agg(F.grouping_id().alias("level"), n.alias("rubric_count"), *cols, *(x for f in flags for x in (F.count_if(f).alias(f"{f}_count"), rate(F.count_if(f)).alias(f"{f}_rate"))))


def merge_judges(cases: DataFrame, judgments: DataFrame) -> DataFrame:
    """Cases (case_id, answer) with all judges' (case_id, judge, answer, verdict, self_judge). A case that a judge lacks, or whose answer differs, is an error."""
    judges = judgments.select("judge").distinct().agg(F.count("*").alias("n_judges"))
    g = judgments.join(cases.select("case_id", F.col("answer").alias("__a")), "case_id").groupBy("case_id").agg(
        F.count_distinct("judge").alias("n"), F.bool_and(F.col("answer").eqNullSafe(F.col("__a"))).alias("same"), F.count_if(F.col("verdict") == "unscored").alias("u"), F.count_distinct("verdict").alias("v"), F.min("verdict").alias("verdict"), F.bool_or("self_judge").alias("any_self_judge")
    )
    m = cases.join(g, "case_id", "left").join(F.broadcast(judges))
    ok = F.when((F.coalesce("n", F.lit(0)) == F.col("n_judges")) & F.coalesce("same", F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a judge lacks or differs on case "), F.col("case_id").cast("string"))).cast("boolean"))
    scored = F.col("u") == 0
    agreed = scored & (F.col("v") == 1)
    right = agreed & (F.col("verdict") == "correct")
    return m.filter(ok).select("case_id", scored.alias("all_judges_scored"), F.when(agreed, F.col("verdict")).alias("unanimous_verdict"), right.alias("dual_correct"), (right & ~F.col("any_self_judge")).alias("independent_dual_correct"), "any_self_judge", (~agreed | F.col("any_self_judge")).alias("manual_review"))


def judge_summaries(judgments: DataFrame) -> DataFrame:
    """Per judge its verdicts and self judgments."""
    return judgments.groupBy("judge").agg(F.count("*").alias("fixed_denominator"), *(F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in VERDICTS), F.round(F.count_if(F.col("verdict") == "correct") / F.count("*"), 4).alias("correct_rate"), F.count_if("self_judge").alias("self_judge_count"))


def stable_rank(*parts: Column | str | int) -> Column:
    """SHA-256 of the parts joined by colons."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def stratified(rows: DataFrame, id_col: str, first: str, second: str, count: int, seed: int) -> DataFrame:
    """Count rows with near-equal quotas over both dimensions, chosen by hash rank.

    Only the first count rows of each stratum can be chosen; the two-way quotas are settled over these in one group.
    The strata are few (as many as the categories), so this group is bounded by strata x count."""
    w = W.partitionBy(first, second).orderBy(stable_rank(seed, F.col(second), F.col(id_col)))
    top = rows.select(id_col, first, second).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= count)

    def choose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        rank = lambda *x: sha256(":".join(map(str, x)).encode()).hexdigest()
        pool = pd.concat(list(it))
        if pool.empty:
            return
        queue = {k: g.sort_values("r")[id_col].tolist() for k, g in pool.groupby([first, second])}
        outer, inner = sorted(pool[first].unique()), sorted(pool[second].unique())

        def quotas(values: list, label: str) -> dict:
            base, rest = divmod(count, len(values))
            more = sorted(values, key=lambda v: rank(seed, label, v))[:rest]
            return {v: base + (v in more) for v in values}

        left_o, left_i, uses, out, turn = quotas(outer, first), quotas(inner, second), {}, [], 0
        while len(out) < count:
            before = len(out)
            for o in outer:
                open_ = [i for i in inner if left_o[o] > 0 and left_i[i] > 0 and queue.get((o, i))]
                if open_:
                    i = min(open_, key=lambda v: (uses.get((o, v), 0), -left_i[v], rank(seed, "pair", turn, o, v)))
                    out.append((queue[o, i].pop(0), o, i))
                    uses[o, i] = uses.get((o, i), 0) + 1
                    left_o[o] -= 1
                    left_i[i] -= 1
            turn += 1
            if len(out) == before:
                raise ValueError(f"only {len(out)} of {count} rows satisfy the quotas")
        yield pd.DataFrame(out, columns=[id_col, first, second]).assign(place=range(1, len(out) + 1))

    schema = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, {first} string, {second} string, place int"
    return top.coalesce(1).mapInPandas(choose, schema)


def generation_status(records: DataFrame) -> DataFrame:
    """Counts of case records (execution_success, report_emitted, contaminated, error) and means of their recorded citation metrics, each with how many have it."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    n = F.count("*")
    kinds = ("citation_grounding", "citation_precision", "citation_coverage", "unsupported_claim_rate")
    means = [x for c in kinds for x in (F.round(F.avg(c), 4).alias(f"{c}_avg"), F.count(c).alias(f"{c}_scored_count"))]
    return records.agg(n.alias("case_count"), yes("execution_success").alias("success_count"), (n - yes("execution_success")).alias("failure_count"), yes("report_emitted").alias("report_emitted_count"), yes("contaminated").alias("contaminated_count"), F.count("error").alias("error_count"), *means)


def forbidden_urls(prompt: Column, task: Column) -> Column:
    """The distinct urls of the list `urls: [...]` that a prompt adds to its task; null where the prompt does not begin with the task or has no such list."""
    rest = F.substr(prompt, F.length(task) + 1, F.length(prompt))
    inside = F.regexp_extract(rest, r"""(?s)['"]urls['"]\s*:\s*\[(.*?)\]""", 1)
    urls = F.array_distinct(F.transform(F.regexp_extract_all(inside, F.lit(r"""(['"])(.*?)\1\s*(?:,|$)"""), F.lit(2)), lambda u: F.regexp_replace(F.regexp_replace(u, "[?#].*$", ""), "/+$", "")))
    return F.when(prompt.startswith(task) & (task != "") & (F.size(urls) > 0), urls)


def pinned(rows: DataFrame, count: int, by: str, counts: dict[str, int]) -> DataFrame:
    """Rows, or an error where their number or the number by category is not what was pinned."""
    wanted = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    g = rows.groupBy(by).agg(F.count("*").alias("n"))
    sums = g.agg(F.sum("n").alias("all"), F.count_if(~F.coalesce(wanted[F.col(by)] == F.col("n"), F.lit(False))).alias("bad"), F.count("*").alias("kinds"))
    ok = F.when((F.col("all") == count) & (F.col("bad") == 0) & (F.col("kinds") == len(counts)), F.lit(True)).otherwise(F.raise_error(F.lit("the snapshot is not the pinned one")).cast("boolean"))
    return rows.join(F.broadcast(sums)).filter(ok).drop("all", "bad", "kinds")
