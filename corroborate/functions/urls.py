"""URL functions by the groups of RFC 3986: dedup keys, identities, domains, display forms, denylists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Hosts and path marks of published benchmarks.
DATA_HOSTS = ["github.com", "raw.githubusercontent.com", "huggingface.co", "hf.co", "datasets-server.huggingface.co"]
BENCHMARK_PATH = r"(?:^|[/_\-.])(?:simpleqa|simple-evals?|livedrbench|deepresearch-bench|deepresearchbench|drb2|deep_research_bench)(?:$|[/_\-.])"
ANSWER_FIELD = r'(?:"|\b)(?:reference_?answer|ground_?truths?|expected_?answer|answers?)(?:"|\b)\s*[:=]'


def part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, PARTS, k)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return F.lower(part(url, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return part(url, 3)


def dedup_key(url: Column, title: Column) -> Column:
    """M1: scheme, authority and path in lower case without slashes at the end; for a blank url the title's words."""
    head = F.when(scheme(url) == "", "").otherwise(F.concat(scheme(url), F.lit(":")))
    there = F.when(authority(url) == "", "").otherwise(F.concat(F.lit("//"), authority(url)))
    words = F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_]+", " "))
    return F.when(F.coalesce(url, F.lit("")) == "", words).otherwise(F.concat(head, there, F.regexp_replace(F.lower(path(url)), "/+$", "")))


def identity(url: Column) -> Column:
    """M2: struct(scheme, host, port, path) with default ports as null and path case kept; null unless http(s) without user info."""
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    number = port.try_cast("int")
    default = F.when(scheme(url) == "https", 443).otherwise(80)
    name = F.regexp_replace(host(url), r"\.$", "")
    ok = scheme(url).isin("http", "https") & (name != "") & ~authority(url).contains("@")
    return F.when(ok, F.struct(scheme(url).alias("scheme"), name.alias("host"), F.when(number != default, number).alias("port"), F.when(path(url) == "", "/").otherwise(path(url)).alias("path")))


def domain(url: Column) -> Column:
    """M4: the authority with its port, else the scheme, else unknown."""
    return F.when(authority(url) != "", authority(url)).when(scheme(url) != "", scheme(url)).otherwise("unknown")


def canonical(url: Column) -> Column:
    """M3, audit: without query and fragment, lower-cased authority, no slashes at the end."""
    return F.regexp_replace(F.concat(scheme(url), F.lit("://"), authority(url), path(url)), "/+$", "")


def display(url: Column) -> Column:
    """An http(s) url without query and fragment; empty if it has user info or names a local or metadata host."""
    name = F.regexp_replace(host(url), r"\.$", "")
    local = name.rlike(r"(?:^|\.)(?:localhost|metadata\.google\.internal)$")
    ok = scheme(url).isin("http", "https") & (name != "") & ~authority(url).contains("@") & ~local
    return F.when(ok, F.concat(scheme(url), F.lit("://"), part(url, 2), path(url))).otherwise("")


def benchmark_url(url: Column) -> Column:
    """Does the url lead to a known benchmark's data?"""
    name = F.regexp_replace(F.regexp_replace(host(url), r"\.$", ""), r"^www\.", "")
    target = F.when(name == "datasets-server.huggingface.co", F.concat(F.lower(path(url)), F.lit(" "), F.lower(F.coalesce(F.try_url_decode(part(url, 4)), part(url, 4))))).otherwise(F.lower(path(url)))
    return name.isin(DATA_HOSTS) & target.rlike(f"(?i){BENCHMARK_PATH}")


def report_folder(path: Column) -> Column:
    """The folder that holds the chapters of an html report, or null for other paths."""
    root = F.regexp_replace(F.regexp_replace(path, r"(?i)\.html$", ""), "/+$", "")
    return F.when(F.lower(path).endswith(".html") & (root != ""), F.concat(root, F.lit("/")))


def folders(path: Column) -> Column:
    """The beginnings of a path that end with a slash, but for the first slash alone."""
    parts = F.split(path, "/")
    places = F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2)))
    return F.when(F.size(parts) > 2, F.transform(places, lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))


def blocks(blocked: Column, candidate: Column) -> Column:
    """J12, on identities of one origin: the same path, or a chapter below a blocked html report."""
    root = F.regexp_replace(F.regexp_replace(blocked["path"], r"(?i)\.html$", ""), "/+$", "")
    chapter = F.lower(blocked["path"]).endswith(".html") & (root != "") & candidate["path"].startswith(F.concat(root, F.lit("/")))
    return (candidate["path"] == blocked["path"]) | chapter


def valid(url: Column) -> Column:
    """P13, as far as it needs no name service: an http(s) url of at most 2048 signs without blanks, controls or user info, with a port from 1 to 65535 and a host that is neither local nor a private or reserved address."""
    port = F.regexp_extract(authority(url), r":(\d+)$", 1)
    name = F.regexp_replace(host(url), r"\.$", "")
    local = name.rlike(r"(?:^|\.)(?:localhost|local|internal|metadata\.google\.internal)$")
    private = name.rlike(r"^(?:0|10|127)\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(?:22[4-9]|23\d|24\d|25[0-5])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^\[")
    good = (F.length(url) <= 2048) & ~url.rlike(r"[\s\x00-\x1f\x7f]") & scheme(url).isin("http", "https") & (name != "") & ~authority(url).contains("@")
    return F.coalesce(good & ((port == "") | ((F.length(port) <= 5) & port.try_cast("bigint").between(1, 65535))) & ~local & ~private, F.lit(False))
