"""Replay and lineage: artifact checks, contracts, cassettes, content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def id_differences(expected: DataFrame, found: DataFrame, key: str = "case_id") -> DataFrame:
    """The ids that only one side has: key, side (missing or extra)."""
    both = expected.select(key, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(key, F.lit(0).alias("e"), F.lit(1).alias("f")))
    g = both.groupBy(key).agg(F.max("e").alias("e"), F.max("f").alias("f")).filter("e <> f")
    return g.select(key, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side"))


def contract(cases: DataFrame, records: DataFrame, equal: list[str], when_given: list[str], key: str = "case_id") -> DataFrame:
    """Per case the fields that differ: those of equal always count, those of when_given only where both sides have them."""
    r = records.select(key, *(F.col(c).alias(f"__{c}") for c in equal + when_given))
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), c) for c in equal]
    differs += [F.when(F.col(c).isNotNull() & F.col(f"__{c}").isNotNull() & (F.col(c) != F.col(f"__{c}")), c) for c in when_given]
    return cases.join(r, key).select(key, F.array_compact(F.array(*differs)).alias("drift"))


def checked_ids(records: DataFrame, key: str = "case_id") -> DataFrame:
    """Records, or an error where an id is blank or repeats."""
    g = records.groupBy(key).agg(F.count("*").alias("n"))
    bad = g.filter((F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "") | (F.col("n") > 1)).agg(F.count("*").alias("bad"))
    ok = F.when(F.col("bad") == 0, F.lit(True)).otherwise(F.raise_error(F.lit("case ids are blank or repeat")).cast("boolean"))
    return records.join(F.broadcast(bad)).filter(ok).drop("bad")


def checked_sequence(cassette: DataFrame) -> DataFrame:
    """A cassette whose sequence numbers are 1 to n, else an error; numbers 1 to n are those that are distinct, from 1, up to their count."""
    s = cassette.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.min("sequence").alias("a"), F.max("sequence").alias("z"))
    ok = F.when((F.col("n") == 0) | ((F.col("n") == F.col("d")) & (F.col("a") == 1) & (F.col("z") == F.col("n"))), F.lit(True)).otherwise(F.raise_error(F.lit("the cassette's sequence is not 1 to n")).cast("boolean"))
    return cassette.join(F.broadcast(s)).filter(ok).select(cassette.columns)


def replayed(cassette: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls (sequence, kind, operation, request) answered by the cassette: response and whether the call is the recorded one; entries without a call have played false."""
    c = cassette.select("sequence", F.col("kind").alias("k"), F.col("operation").alias("o"), F.col("request").alias("r"), "response")
    j = c.join(calls, "sequence", "full")
    same = F.col("kind").eqNullSafe(F.col("k")) & F.col("operation").eqNullSafe(F.col("o")) & F.col("request").eqNullSafe(F.col("r"))
    return j.select("sequence", F.when(same, F.col("response")).alias("response"), same.alias("matches"), F.col("kind").isNotNull().alias("played"))


def inventory(cassette: DataFrame) -> DataFrame:
    """Entries and sorted operations by kind."""
    return cassette.groupBy("kind").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as one JSON object with its keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def set_hash(rows: DataFrame, order: str, *columns: str) -> DataFrame:
    """One id, 16 hex digits, for a whole set of rows: the hash of the rows' hashes in order of a key."""
    return rows.select(F.col(order).alias("o"), canonical_hash(*columns).alias("h")).agg(F.substr(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256), F.lit(1), F.lit(16)).alias("manifest_id"))


def judge_identities(rows: DataFrame, run: str, order: str) -> DataFrame:
    """Per run the distinct (provider, model) in the order they first appear."""
    first = rows.groupBy(run, F.lower("provider").alias("provider"), "model").agg(F.min(order).alias("at"))
    return first.select(run, "provider", "model", F.row_number().over(W.partitionBy(run).orderBy("at")).alias("place"))


def determinism(replay: Column, mock: Column, live: Column) -> Column:
    """The mode of a benchmark run."""
    return F.when(replay, "replay").when(mock & live, "mixed").when(live, "live").otherwise("mock")


def self_judged(judge: Column, models: Column) -> Column:
    """The judge's model is one that generated: equal, or the requested name with a date behind it."""
    return F.exists(models, lambda m: (judge == m) | (judge.startswith(F.concat(m, F.lit("-"))) & F.regexp_extract(judge, r"-(\d{6}|\d{8})$", 0).eqNullSafe(F.substr(judge, F.length(m) + 1, F.lit(9))) & (F.length(judge) > F.length(m))))


def opaque_ref(case_id: Column) -> Column:
    """P20: a case's id for sealed output."""
    return F.concat(F.lit("case-"), F.substr(F.sha2(case_id.cast("string"), 256), F.lit(1), F.lit(12)))


def redact_settings(settings: Column) -> Column:
    """A settings map with the values of secret names hidden."""
    secret = lambda k: F.lower(k).rlike(r"(?:_api_key|_token|_secret|_password)$|^(?:api_key|token|secret|password)$")
    return F.transform_values(settings, lambda k, v: F.when(secret(k), F.when(F.coalesce(v, F.lit("")) == "", "").otherwise("<redacted>")).otherwise(v))
