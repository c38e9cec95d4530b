"""Readers and writers: corpora, directories, evaluation cases, IR data sets, artifacts, run tables."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from corroborate.functions import text as T
from corroborate.operators import replay as R
from corroborate.session import ship, written

CORPUS = "id string, title string, url string, content string"
RUNS = "run_id string, status string, stage string, created timestamp_ntz, updated timestamp_ntz, worker string, expires timestamp_ntz, request string, result string"
STEPS = "run_id string, step_id string, stage string, status string, created timestamp_ntz, retries int, payload string"
EVENTS = "event_id long, run_id string, stage string, status string, ts timestamp_ntz, payload string"
TRACE = "run_id string, stage string, status string, timestamp timestamp, duration_ms double, payload string"
CASSETTE = "sequence long, kind string, operation string, request string, response string, metadata string"
EXTENSIONS = ("md", "markdown", "txt", "pdf", "docx")
EXCLUDED = (".git", "__pycache__", "node_modules", ".venv")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus; blank lines are skipped, a missing file is an empty corpus, the url stands in for a missing id."""
    if not exists(spark, path):
        return spark.createDataFrame([], CORPUS)
    rows = spark.read.schema(CORPUS).json(path).filter("id is not null or title is not null or url is not null or content is not null")
    return rows.withColumn("id", F.coalesce("id", "url"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K1: one JSON object a line, nulls kept, no escapes for other than ASCII signs."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


@F.arrow_udf(Y.StringType())
def _document_text(content: pa.Array, kind: pa.Array) -> pa.Array:
    """The text of DOCX (paragraphs, then table rows joined by bars) and PDF files (pages), where the libraries are there; else UTF-8."""

    def text(raw: bytes, ext: str) -> str:
        if ext == "docx":
            import docx

            d = docx.Document(io.BytesIO(raw))
            return "\n".join([p.text for p in d.paragraphs] + [" | ".join(c.text for c in r.cells) for t in d.tables for r in t.rows])
        if ext == "pdf":
            import pypdf

            return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages)
        return raw.decode("utf-8", "replace")

    return pa.array([text(x or b"", k) for x, k in zip(content.to_pylist(), kind.to_pylist(), strict=True)], pa.string())


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def walk(files: DataFrame, root: str, extensions: tuple[str, ...] = EXTENSIONS, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """S3: files (path, ...) below root with a wanted extension and no excluded folder above them, with rel, their path from root."""
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", ""), f"^{base}/", "")
    folders = F.split(F.regexp_replace(rel, "/?[^/]*$", ""), "/")
    return files.withColumn("rel", rel).filter(_suffix(F.col("rel")).isin(list(extensions)) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in excluded])))


def ingest(spark: SparkSession, root: str, max_chars: int | None = None, **walk_options) -> DataFrame:
    """The documents of a directory tree as a corpus, with skipped true where nothing is left after cleaning."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    found = walk(files, root, **walk_options)
    ext = _suffix(F.col("rel"))
    raw = F.when(ext.isin("docx", "pdf"), _document_text("content", ext)).otherwise(F.decode("content", "UTF-8"))
    text = T.cleaned(raw)
    text = text if max_chars is None else T.stripped(F.substr(text, F.lit(1), F.lit(max_chars)))
    stem = F.regexp_replace(F.regexp_extract("rel", r"([^/]+)$", 1), r"\.[^.]+$", "")
    rows = found.select("rel", "path", text.alias("content"), ext.alias("ext"), stem.alias("stem"))
    meta = F.struct(F.col("rel").alias("source_path"), F.col("ext").alias("ingest_format"))
    return rows.select(T.slug(F.col("rel")).alias("id"), T.title_of(F.col("content"), F.col("stem")).alias("title"), F.col("path").alias("url"), "content", meta.alias("metadata"), (F.col("content") == "").alias("skipped"))


def ingest_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(~F.col("skipped")).alias("document_count"), F.count_if("skipped").alias("skipped_count"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a .jsonl, .json (a list, or an object with rows or cases) or .csv file, as JSON rows with their place."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif kind in ("json", "jsonl"):
        rows = spark.read.option("multiLine", kind == "json").json(path)
        for key in ("rows", "cases"):
            if key in rows.columns and dict(rows.dtypes)[key].startswith("array"):
                rows = rows.select(F.explode(key).alias("r")).select("r.*")
    else:
        raise ValueError(f"cases must be jsonl, json or csv: {path}")
    return rows.withColumn("ord", F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with __n, their place from 1 in the order of a column. Rows are sorted in ranges and counted by range, so no task sees them all."""
    spark = rows.sparkSession
    sorted_ = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    held = written(spark, sorted_, "numbered")
    part = F.shiftright("__at", 33)
    sizes = held.groupBy(part.alias("__p")).agg(F.count("*").alias("__c"))  # a row a range
    before = sizes.select("__p", (F.sum("__c").over(W.orderBy("__p")) - F.col("__c")).alias("__b"))
    place = held.withColumn("__p", part).join(F.broadcast(before), "__p").withColumn("__n", F.col("__b") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
    return place.drop("__p", "__b", "__at")


def normalised_cases(rows: DataFrame, benchmark: str) -> DataFrame:
    """Id, query, category, benchmark_name and the other fields as a map; a row without a query is an error, and so is a deep report in another format than Markdown."""
    have = set(rows.columns)
    first = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in have], F.lit(None).cast("string"))
    placed = numbered(rows if "ord" in have else rows.withColumn("ord", F.monotonically_increasing_id()), "ord")
    used = {"id", "case_id", "key", "query", "question", "prompt", "input", "category", "ord"}
    rest = [c for c in rows.columns if c not in used]
    as_text = lambda c: F.col(c).cast("string") if dict(rows.dtypes)[c] == "string" else F.to_json(F.struct(c))
    meta = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), as_text(c))]), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    query = first("query", "question", "prompt", "input")
    asked = F.when(query.isNotNull(), query).otherwise(F.raise_error(F.lit("a case has no query")).cast("string"))
    n = placed.select(F.coalesce(first("id", "case_id", "key"), F.format_string("case-%04d", F.col("__n").cast("int"))).alias("id"), asked.alias("query"), first("category").alias("category"), F.lit(benchmark).alias("benchmark_name"), meta.alias("metadata"))
    deep = (F.coalesce(F.try_element_at("metadata", F.lit("report_depth")), F.lit("")) == "deep") & (F.coalesce(F.try_element_at("metadata", F.lit("expected_format")), F.lit("markdown")) != "markdown")
    return n.withColumn("id", F.when(deep, F.raise_error(F.lit("a deep report must be Markdown")).cast("string")).otherwise(F.col("id")))


def window_of(rows: DataFrame, offset: int, limit: int | None, order: str = "ord") -> DataFrame:
    """A part of the cases by their place."""
    part = rows.orderBy(order).offset(offset)
    return part if limit is None else part.limit(limit)


def ir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents of an IR data set."""
    return spark.read.schema("_id string, title string, text string").json(path).select(F.col("_id").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))


def ir_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("query_id"), "text")


def ir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Relevant pairs of a TSV with the columns query-id, corpus-id and score; the last of repeated pairs counts."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path).withColumn("ord", F.monotonically_increasing_id())
    last = rows.groupBy(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("doc_id")).agg(F.max_by(F.col("score").cast("int"), "ord").alias("rel"))
    return last.filter("rel > 0")


def case_results(spark: SparkSession, path: str) -> DataFrame:
    """The case results of an artifact; blank or repeated ids are an error."""
    return R.checked_ids(spark.read.json(path).filter("type = 'case_result'"))


def generation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(config, case results) of an artifact with exactly one config row."""
    rows = spark.read.json(path)
    config = rows.filter("type = 'config'")
    n = config.agg(F.count("*").alias("n"))
    one = F.when(F.col("n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("an artifact needs one config row")).cast("boolean"))
    return config.join(F.broadcast(n)).filter(one).drop("n"), R.checked_ids(rows.filter("type = 'case_result'"))


def cassette(spark: SparkSession, path: str) -> DataFrame:
    """S14."""
    return R.checked_sequence(spark.read.schema(CASSETTE).json(path))


def write_cassette(entries: DataFrame, path: str) -> None:
    """K6: entries with their keys in order, by sequence."""
    write_jsonl(entries.select(*sorted(entries.columns)).repartitionByRange("sequence").sortWithinPartitions("sequence"), path)


def run_table(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """Runs, steps or events as Parquet; columns added later read as null in older files."""
    return spark.read.option("mergeSchema", True).schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_benchmark(results: DataFrame, summary: DataFrame, path: str, manifest_id: str) -> None:
    """K2: raw results and their summary below the manifest's id."""
    write_jsonl(results, f"{path}/{manifest_id}/raw")
    write_jsonl(summary, f"{path}/{manifest_id}/summary")


def append_judgments(judged: DataFrame, path: str) -> None:
    """K7: new judgments behind the old ones."""
    write_jsonl(judged, path, "append")


def report_markdown(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """K4: per report a Markdown text of claims (report_id, ord, claim) and sources (report_id, source_id, title, url), and an HTML one."""
    c = claims.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "claim"))), lambda x: F.concat(F.lit("- "), x["claim"])), "\n").alias("c"))
    s = sources.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", "title", "url"))), lambda x: F.concat(F.lit("- ["), x["source_id"], F.lit("] "), x["title"], F.lit(" - "), x["url"])), "\n").alias("s"))
    body = F.concat(F.lit("# Report "), F.col("report_id").cast("string"), F.lit("\n\n"), "c", F.lit("\n\n## Sources\n"), F.coalesce("s", F.lit("")))
    escaped = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return c.join(s, "report_id", "left").select("report_id", body.alias("markdown"), F.concat(F.lit("<pre>"), escaped, F.lit("</pre>")).alias("html"))
