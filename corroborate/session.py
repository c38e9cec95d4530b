"""Session defaults, and tables written to the folder that all executors share."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and bench.py; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corroborate")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


BATCH_RECORDS = "1000"


def _zipped() -> bytes:
    """The source files of this package as a zip, the same bytes for the same sources."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((Path(ROOT) / "corroborate").rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(ROOT))), f.read_bytes(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it is run from a source tree, and bound what they hold at once.

    In local mode the workers read the source tree. On a cluster it is zipped into the shared folder and added to the context,
    once, so that executors need no disk in common with the driver's.

    Rows here are whole documents, so Arrow batches of Spark's default of 10,000 records take tens of MB in the JVM and
    again in Python, in every task; a batch size that the session's own configuration names stays, whatever it is."""
    sc = spark.sparkContext
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if sc.getConf().get(batch) is None and spark.conf.get(batch) == "10000":
        spark.conf.set(batch, BATCH_RECORDS)
    if sc.master == "local" or sc.master.startswith("local["):
        env = sc.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
        return
    content = _zipped()
    name = f"corroborate-{hashlib.sha256(content).hexdigest()[:16]}.zip"
    if name not in sc._python_includes:
        jvm, path = sc._jvm, f"{shared_dir(spark)}/corroborate/{name}"
        at = jvm.org.apache.hadoop.fs.Path(path)
        out = at.getFileSystem(sc._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(content))
        out.close()
        sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a folder of our own in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corroborate-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corroborate/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors, and gives the planner true sizes."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table that written() made and nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def size_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; exact for a table from written()."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


DEALT = "spark.corroborate.dealSmallTables"
SMALL_BYTES = (2 << 20, 256 << 20)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table. Where the session sets DEALT (bench.py does, on one machine), a small table in fewer files than cores is dealt out after the scan, as one row group is read by one task."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spark.conf.get(DEALT, "false") == "true":
        cores = spark.sparkContext.defaultParallelism
        if SMALL_BYTES[0] <= size_bytes(df) <= SMALL_BYTES[1] and len(df.inputFiles()) < cores:
            return df.repartition(cores)
    return df


HOT_PARTS = 1024


def hot_keys(df: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """Of a table with one row per key the rows whose count n is over rows/HOT_PARTS: fewer than HOT_PARTS rows, as the counts add up to rows."""
    return df.filter(F.col(n) > F.lit(rows // HOT_PARTS)).filter(F.col(key).isNotNull())


def answered(rows: DataFrame, answers: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined by key with answers, which have one row per key and in n how many rows have it: hot keys' answers, fewer than HOT_PARTS, are broadcast; the rest is an ordinary join."""
    hot = F.broadcast(hot_keys(answers, key, n, total))
    cold = answers.filter(F.col(n) <= F.lit(total // HOT_PARTS))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def answered_or_not(rows: DataFrame, answers: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """As answered(), but rows without an answer stay, with nulls; rows without a key go past the joins. Every key of many rows must have an answer."""
    hot = F.broadcast(hot_keys(answers, key, n, total).withColumn("__hot", F.lit(True)))
    cold = answers.filter(F.col(n) <= F.lit(total // HOT_PARTS))
    one = rows.filter(F.col(key).isNotNull()).join(hot, key, "left")
    two = one.filter("__hot is null").select(key, *[c for c in rows.columns if c != key]).join(cold, key, "left")
    none = rows.filter(F.col(key).isNull()).select(key, *[c for c in rows.columns if c != key], *[F.lit(None).cast(answers.schema[c].dataType).alias(c) for c in answers.columns if c != key])
    return one.filter("__hot").drop("__hot").unionByName(two).unionByName(none)
