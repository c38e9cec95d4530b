"""URL filter by redirect equivalence, with DataFrame functions only.

Rules (host, path, verdict) fit a host and all its subdomains where the url's path starts with the rule's path;
the longest host, then the longest path, wins. Redirects (meta refresh) and canonical links join urls into
components, found by distributed connected components; a url without a rule of its own takes over its
component's decision: allow if any member is allowed by rule, else block if any is blocked, else allow.

All such links of a page count, but for those in comments, in scripts and in other elements whose text is no markup. Tags and
their attributes are read in order, quoted values as units. Character references in a link are decoded, and the link is
resolved against the page's `<base>` or url. Nodes of the graph are urls without fragment, with scheme and host in
lower case, without a default port or dot segments, with `/` for an empty path, and with percent-escapes of unreserved
signs decoded and those of others in capitals.

Cases: a null url, or one without `://`, has empty host and path, fits no rule and is no node of the graph, nor is one
without scheme or host; a tag whose quote is never closed is none; null html has no links; repeated urls are one node; links to oneself count for nothing, nor do those that aren't to
a host (`mailto:`); a link's target need not be a page itself, its rule counts all the same; rows without a url go
past the join, and urls of many rows are joined apart; other columns are never looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corroborate.llm.graph import components
from corroborate.session import answered, hot_keys, written

# what a tag holds up to its end: a quote counts right after `=` alone, and hides what is in it; an open one takes all that follows
_HELD = r"""(?:[^>=]++|=[\s]*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))|=)*+"""
TAG = rf"(?is)<([a-z][^\s/>]*+)({_HELD})(>?)"
# comments, and elements whose text is no markup
HIDDEN = rf"(?is)<!--(?:-?>|.*?(?:--!?>|\z))|<(script|style|textarea|title|template|xmp|iframe|noembed|noframes)(?=[\s/>]){_HELD}>.*?(?:</\1(?=[\s/>])|\z)"
ATTRIBUTE = r"""(?is)([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?"""
_ESCAPE = r"(?s)^([0-9A-Fa-f]{2})(.*)$"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
REFERENCE = r"(?is)^(?:#x([0-9a-f]{1,6})|#([0-9]{1,7})|(amp|lt|gt|quot|apos));(.*)$"
DELAYED = r"""(?is)^[\s0-9.]*[;,]?\s*(?:url\s*=\s*)?["']?([^"']*)"""
_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct(name, verdict) of the rule that wins, or null. Rules are few: they become one CASE, the longest first."""
    case = None
    for r in sorted(rules, key=lambda r: (-len(r.host), -len(r.path), r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        told = F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))
        case = F.when(fits, told) if case is None else case.when(fits, told)
    return case if case is not None else F.lit(None).cast("struct<name:string,verdict:string>")


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute in what a tag holds, as it is written, or ''. Attributes are read in order, so none is found in another's value."""
    names, *values = (F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2, 3, 4))
    both = lambda a, b: F.concat(a, b)
    each = F.zip_with(names, F.zip_with(values[0], F.zip_with(values[1], values[2], both), both), lambda n, v: F.struct(F.lower(n).alias("n"), v.alias("v")))
    return F.coalesce(F.get(F.filter(each, lambda x: x["n"] == name), F.lit(0))["v"], F.lit(""))


def decoded(text: Column) -> Column:
    """Character references by number and the five names of XML, each once."""

    def piece(x: Column) -> Column:
        code = F.when(x["hex"] != "", F.conv(x["hex"], 16, 10)).otherwise(x["dec"]).cast("long")
        sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        sign = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        named = F.element_at(F.create_map(*[F.lit(v) for kv in NAMED.items() for v in kv]), F.lower(x["name"]))
        return F.when(x["name"] != "", F.concat(named, x["rest"])).when((x["hex"] != "") | (x["dec"] != ""), F.concat(sign, x["rest"])).otherwise(F.concat(F.lit("&"), x["p"]))

    split = F.transform(F.split(text, "&"), lambda p: F.struct(p.alias("p"), *[F.regexp_extract(p, REFERENCE, k).alias(n) for k, n in enumerate(("hex", "dec", "name", "rest"), 1)]))
    first = F.transform(split, lambda x, i: F.when(i == 0, x["p"]).otherwise(piece(x)))
    return F.when(text.contains("&"), F.array_join(first, "")).otherwise(text)


def _plain(text: Column) -> Column:
    """Percent-escapes of unreserved signs as the signs, those of others in capitals; a `%` without two hex digits stays."""

    def piece(p: Column) -> Column:
        code = F.conv(F.regexp_extract(p, _ESCAPE, 1), 16, 10).cast("int")
        sign = F.chr(code)
        rest = F.regexp_extract(p, _ESCAPE, 2)
        return F.when(~p.rlike(_ESCAPE), F.concat(F.lit("%"), p)).when(sign.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(sign, rest)).otherwise(F.concat(F.lit("%"), F.upper(F.substring(p, 1, 2)), rest))

    whole = F.array_join(F.transform(F.split(text, "%"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")
    return F.when(text.contains("%"), whole).otherwise(text)


def _dotless(path: Column) -> Column:
    """A path that begins with `/`, its `.` and `..` segments resolved."""
    back = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == "..", back(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    # a last `.` or `..` leaves an empty segment behind
    parts = F.split(F.regexp_replace(F.substring(path, 2, 1 << 30), r"(^|/)(\.{1,2})$", "$1$2/"), "/")
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(path.contains("/."), whole).otherwise(path)


def staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each worked out once: they come from a generator of one row, since the optimizer puts the expression of a plain column wherever it is used, filters included."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_node(rows: DataFrame, url: str, out: str) -> DataFrame:
    """rows with the node of the column url, null where it has no scheme or host."""
    part = staged(rows, __s=_lower(F.regexp_extract(url, _PARTS, 1)), __h=F.regexp_replace(_lower(F.regexp_extract(url, _PARTS, 2)), ":$", ""), __p=_plain(F.regexp_extract(url, _PARTS, 3)), __q=_plain(F.regexp_extract(url, _PARTS, 4)))
    host = F.when(F.col("__s") == "http", F.regexp_replace("__h", ":80$", "")).when(F.col("__s") == "https", F.regexp_replace("__h", ":443$", "")).otherwise(F.col("__h"))
    node = F.when((F.col("__s") != "") & (F.col("__h") != ""), F.concat(F.col("__s"), F.lit("://"), host, F.when(F.col("__p") == "", "/").otherwise(_dotless(F.col("__p"))), F.col("__q")))
    return staged(part, **{out: node}).drop("__s", "__h", "__p", "__q")


def with_resolved(rows: DataFrame, link: str, base: str, out: str) -> DataFrame:
    """rows with the link of the column link, on a page whose base is the absolute url in the column base; blanks around it and line ends in it don't count."""
    part = staged(rows, __t=F.regexp_replace(link, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\r\n]", ""), __s=F.regexp_extract(base, _PARTS, 1), __h=F.regexp_extract(base, _PARTS, 2), __p=F.regexp_extract(base, _PARTS, 3))
    t, path = F.col("__t"), F.col("__p")
    origin = F.concat(F.col("__s"), F.lit("://"), F.col("__h"))
    found = (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.rlike("(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(t.startswith("//"), F.concat(F.col("__s"), F.lit(":"), t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("?"), F.concat(origin, path, t))
        .when(t.startswith("#"), F.col(base))
        .otherwise(F.concat(origin, F.when(path == "", "/").otherwise(F.regexp_extract(path, "(?s)^(.*/)", 1)), t))
    )
    return staged(part, **{out: found}).drop("__t", "__s", "__h", "__p")


def edges_of(pages: DataFrame) -> DataFrame:
    """(source, target) nodes of canonical links and refreshes in the html, none to oneself."""
    linked = pages.filter(F.col("url").contains("://") & (F.lower("html").contains("canonical") | F.lower("html").contains("refresh")))
    seen = staged(linked.select("url", "html"), h=F.regexp_replace("html", HIDDEN, "")).select("url", "h")
    pieces = lambda k: F.regexp_extract_all("h", F.lit(TAG), F.lit(k))
    closed = F.zip_with(pieces(2), pieces(3), lambda t, e: F.when(e == ">", t))
    tags = F.zip_with(pieces(1), closed, lambda n, t: F.struct(F.lower(n).alias("kind"), t.alias("tag")))
    some = staged(seen, tags=F.filter(tags, lambda x: x["kind"].isin("base", "link", "meta") & x["tag"].isNotNull())).select("url", "tags")
    base = F.get(F.filter("tags", lambda x: x["kind"] == "base"), F.lit(0))["tag"]
    each = some.select("url", base.alias("base"), F.explode("tags").alias("x"))
    wanted = each.select("url", "base", "x.kind", "x.tag").filter((F.col("kind") == "link") & _attribute(F.col("tag"), "rel").rlike(r"(?i)(?:^|\s)canonical(?:$|\s)") | (F.col("kind") == "meta") & _attribute(F.col("tag"), "http-equiv").rlike(r"(?i)^\s*refresh\s*$"))
    written_out = staged(wanted, __base=_attribute(F.col("base"), "href"), __text=F.when(F.col("kind") == "link", _attribute(F.col("tag"), "href")).otherwise(_attribute(F.col("tag"), "content")))
    text = staged(written_out, above=decoded(F.col("__base")), text=decoded(F.col("__text")))
    link = F.when(F.col("kind") == "link", F.col("text")).otherwise(F.regexp_extract("text", DELAYED, 1))
    based = staged(with_resolved(text.select("url", "above", link.alias("link")), "above", "url", "found"), whole=F.coalesce("found", "url"))
    ends = with_node(with_node(with_resolved(based, "link", "whole", "to"), "url", "source"), "to", "target")
    return ends.select("source", "target").filter("source <> target")


def judge(spark: SparkSession, pages: DataFrame, edges: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, by (rule, alias or default). edges: (source, target) urls beside those in the html."""
    found = edges_of(pages.select("url", "html"))
    if edges is not None:
        more = edges.select(F.col("source").alias("from"), F.col("target").alias("to"))
        found = found.unionByName(with_node(with_node(more, "from", "source"), "to", "target").select("source", "target").filter("source <> target"))
    links = written(spark, found, "links")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("own", rule)
    if links.isEmpty():
        passed = seen.withColumn("passed", F.lit(None).cast("string"))
    else:
        nodes = written(spark, components(spark, links.select(F.col("source").alias("a"), F.col("target").alias("b"))), "nodes")
        judged = nodes.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))).withColumn("verdict", rule["verdict"])
        rank = F.max(F.when(F.col("verdict") == "allow", 2).when(F.col("verdict") == "block", 1))
        decided = judged.groupBy("root").agg(rank.alias("rank"), F.count("*").alias("n"))
        told = answered(nodes, decided, "root", "n", nodes.count()).filter("rank is not null").select("node", F.when(F.col("rank") == 2, "allow").otherwise("block").alias("passed"))
        # pages without a rule and with a url are asked about, the rest goes past the join; urls of many pages, fewer than HOT_PARTS, are joined apart
        told = written(spark, told, "aliases")
        asked = written(spark, with_node(seen.filter(F.col("own").isNull()), "url", "node"), "asked")
        named = asked.filter("node is not null")
        counts = named.groupBy("node").agg(F.count("*").alias("n"))
        hot = written(spark, hot_keys(counts, "node", "n", named.count()).join(told, "node", "left").select("node", F.col("passed").alias("of_hot"), F.lit(True).alias("hot")), "hot")
        one = named.join(F.broadcast(hot), "node", "left")
        two = one.filter("hot is null").join(told, "node", "left")  # its size is known to the planner, which broadcasts it only if small
        columns = ["page_id", "host", "path", "own", "passed"]
        none = F.lit(None).cast("string").alias("passed")
        past = asked.filter("node is null").select("page_id", "host", "path", "own", none).unionByName(seen.filter(F.col("own").isNotNull()).select("page_id", "host", "path", "own", none))
        passed = one.filter("hot").withColumn("passed", F.col("of_hot")).select(*columns).unionByName(two.select(*columns)).unionByName(past)
    by = F.when(F.col("own").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default")
    return passed.select("page_id", "host", "path", F.col("own.name").alias("rule"), F.coalesce("own.verdict", "passed", F.lit("allow")).alias("verdict"), by.alias("by"))
