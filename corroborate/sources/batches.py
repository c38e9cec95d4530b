"""K7: batches of judgments in one folder, each counted once: a data source whose tasks write parts and whose commit names them.

A batch is written by tasks as JSON lines, a part file a task attempt. Only the commit, one small file with the batch's name that
appears by a rename, makes its parts count: parts of failed or repeated attempts are in no commit, and an aborted batch's are removed. A
batch whose commit is there is not written again. One writer at a time may write a batch of one name; batches of several names may be
written side by side.

Cases: an empty batch has a commit without parts; a folder without commits holds no rows; nulls are kept; without a name a batch is
named by its rows (their number and two sums of their hashes), so the same rows in any order are the same batch.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corroborate.operators.judging import latest, pending
from corroborate.session import ship

# The keys of a header that a resumed run must share with the run before.
HEADER = ("schema_version", "protocol_name", "generation_artifact_id", "generation_manifest_id", "rubrics_sha256", "judge_role", "requested_judge_model", "prompt_version", "batch_size", "expected_rubric_count")
FORMAT = "corroborate_batches"


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, batch: str) -> None:
        self.path, self.batch = path, batch
        self.there = self._is_there()

    def _place(self) -> tuple:
        from pyarrow import fs

        uri = self.path.replace("s3a://", "s3://")
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)

    def _is_there(self) -> bool:
        from pyarrow import fs

        files, root = self._place()
        return files.get_file_info(f"{root}/commits/{self.batch}.json").type != fs.FileType.NotFound

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        files, root = self._place()
        name, rows = f"{self.batch}-{uuid.uuid4().hex}.jsonl", 0
        if self.there:
            return Part(None, sum(b.num_rows for b in iterator))
        out = None
        for b in iterator:
            if b.num_rows and out is None:
                out = files.open_output_stream(f"{root}/rows/{name}")
            if b.num_rows:
                out.write(("\n".join(b.column(0).to_pylist()) + "\n").encode())
                rows += b.num_rows
        if out is None:
            return Part(None, 0)
        out.close()
        return Part(name, rows)

    def _drop(self, messages: list) -> None:
        files, root = self._place()
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{root}/rows/{m.name}")

    def commit(self, messages: list) -> None:
        if self.there or self._is_there():
            return self._drop(messages)
        files, root = self._place()
        parts = sorted((m.name, m.rows) for m in messages if m.name)
        held = f"{root}/commits/_{self.batch}-{uuid.uuid4().hex}"
        with files.open_output_stream(held) as out:
            out.write(json.dumps({"batch": self.batch, "n_rows": sum(n for _, n in parts), "parts": [p for p, _ in parts]}).encode() + b"\n")
        files.move(held, f"{root}/commits/{self.batch}.json")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class Batches(DataSource):
    """df.write.format(FORMAT).mode("append").options(path=..., batch=...) of one string column, value."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> Y.StructType:
        return Y.StructType([Y.StructField("value", Y.StringType())])

    def writer(self, schema: Y.StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["batch"])


COMMIT = "batch string, n_rows long, parts array<string>"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _qualified(spark: SparkSession, path: str) -> str:
    files, p = _folder(spark, path)
    return str(files.makeQualified(p).toString())


def batch_name(rows: DataFrame) -> str:
    """A name of rows by their values, whatever their order."""
    h = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    a = rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit((1 << 31) - 1))).alias("s")).first()
    return f"{a.n}-{(a.x or 0) & (1 << 64) - 1:016x}-{a.s or 0:x}"


def append(rows: DataFrame, path: str, batch: str | None = None) -> str:
    """Write rows as a batch unless it is there already; its name."""
    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(Batches)
    name = batch or batch_name(rows)
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"no name for a batch: {name}")
    at = _qualified(spark, path)
    files, p = _folder(spark, f"{at}/commits/{name}.json")
    if files.exists(p):
        return name
    for sub in ("rows", "commits"):
        files, p = _folder(spark, f"{at}/{sub}")
        files.mkdirs(p)
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.format(FORMAT).mode("append").options(path=at, batch=name).save()
    return name


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The batches of a folder: batch, n_rows, parts."""
    files, p = _folder(spark, f"{_qualified(spark, path)}/commits")
    there = files.exists(p) and any(not f.getPath().getName().startswith("_") for f in files.listStatus(p))
    return spark.read.schema(COMMIT).json(str(p.toString())) if there else spark.createDataFrame([], COMMIT)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the committed batches. The driver holds the names of their parts, as it does of any table's files."""
    at = _qualified(spark, path)
    names = [r.p for r in commits(spark, path).select(F.explode("parts").alias("p")).collect()]
    return spark.read.schema(schema).json([f"{at}/rows/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def opened(spark: SparkSession, path: str, header: dict, resume: bool = False) -> bool:
    """Begin a judge's folder with its header, or with resume go on in one; whether it was there. A folder that is there without resume is an error, and so is a header that differs in a key of HEADER."""
    missing = [k for k in HEADER if k not in header]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    at = f"{_qualified(spark, path)}/header.json"
    files, p = _folder(spark, at)
    if not files.exists(p):
        files.mkdirs(p.getParent())
        out = files.create(p, False)
        out.write(bytearray((json.dumps(header, ensure_ascii=False, sort_keys=True) + "\n").encode()))
        out.close()
        return False
    if not resume:
        raise FileExistsError(f"there are judgments in {path}")
    old = json.loads(spark.read.text(at).first().value)
    differ = [k for k in HEADER if old.get(k) != header[k]]
    if differ:
        raise ValueError(f"the run to resume has another {', '.join(differ)}")
    return True


def resumable(judged: DataFrame, specs: DataFrame, header: dict) -> DataFrame:
    """The latest judgments (rubric_id, rubric_sha256, judge_role, requested_judge_model, score, attempt) of a folder; rows that the specs (rubric_id, rubric_sha256) and header do not allow are an error."""
    known = specs.select("rubric_id", F.col("rubric_sha256").alias("__sha"))
    rows = latest(judged).join(known, "rubric_id", "left")
    wrong = (
        F.when(F.col("__sha").isNull(), "unknown rubric")
        .when(~F.col("rubric_sha256").eqNullSafe(F.col("__sha")), "another text of rubric")
        .when(~F.col("judge_role").eqNullSafe(F.lit(header["judge_role"])), "another role for rubric")
        .when(~F.col("requested_judge_model").eqNullSafe(F.lit(header["requested_judge_model"])), "another model for rubric")
        .when(~F.coalesce(F.col("score").isin(-1, 0, 1), F.lit(False)), "no valid score for rubric")
    )
    ok = F.when(wrong.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", wrong, F.col("rubric_id").cast("string"))).cast("boolean"))
    return rows.filter(ok).drop("__sha")


def to_judge(judged: DataFrame, specs: DataFrame, header: dict, retry: bool = False) -> DataFrame:
    """The specs that a resumed run has left: without a judgment, or with retry judged -1."""
    return pending(specs, resumable(judged, specs, header), retry=retry)
