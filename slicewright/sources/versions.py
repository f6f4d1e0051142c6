"""Tables in a folder whose versions are committed at once.

``data/batch=<token>/part=<value>/file=<number>/`` holds the rows; every writer has a batch of its own, so two writers never
touch the same directory, and within its batch it overwrites partitions dynamically, so a task or job that runs
again replaces what it wrote. ``log/<number>`` are the commits: each names the batches that count and a table of
the (batch, part) that were replaced since. An entry is made exclusively and follows the one its writer started
from: who finds it taken has lost the race and gets a ``VersionConflict``; its batch stays invisible. So no append
is lost between a check and a commit, a reader sees one version from begin to end, and a lost executor or driver
leaves nothing half done. The file system has to support the exclusive creation of a file, as HDFS does.

``vacuum`` deletes the directories that were replaced; after it a read is a plain scan of the partitions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH, PART, FILE = "slicewright_batch", "slicewright_part", "slicewright_file"


class VersionConflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Version:
    """One committed version; ``number`` -1 is the table before its first."""

    path: str
    number: int
    batches: list[str]
    dead: str | None
    schema: str | None


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _entry(path: str, number: int) -> str:
    return f"{path}/log/{number:012d}"


def latest(spark: SparkSession, path: str) -> Version:
    """The last committed version. An entry still without content isn't committed."""
    fs, log = _fs(spark, f"{path}/log")
    names = sorted((int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(log) else []
    for number in names:
        fs, p = _fs(spark, _entry(path, number))
        stream = fs.open(p)
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text:
            return Version(path, number, **json.loads(text))
    return Version(path, -1, [], None, None)


def commit(spark: SparkSession, path: str, base: Version, batches: list[str], dead: str | None, schema: str) -> Version:
    """Make the next version after ``base``, or raise VersionConflict if there is one already."""
    fs, p = _fs(spark, _entry(path, base.number + 1))
    try:
        out = fs.create(p, False)
    except Exception as e:  # the JVM's FileAlreadyExistsException
        if "AlreadyExists" in str(e):
            raise VersionConflict(f"version {base.number + 1} of {path} is taken") from e
        raise
    out.write(json.dumps({"batches": batches, "dead": dead, "schema": schema}).encode())
    out.close()
    return Version(path, base.number + 1, batches, dead, schema)


def write_batch(df: DataFrame, path: str, token: str) -> None:
    """Write ``df``, which has the columns PART and FILE, as partitions of one batch."""
    writer = df.withColumn(BATCH, F.lit(token)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(BATCH, PART, FILE).parquet(f"{path}/data")


def append(spark: SparkSession, path: str, df: DataFrame, partition: str | Column) -> Version:
    """Add rows as a new version, partitioned by a column, which stays a column of the rows as well, or by an expression."""
    base, token = latest(spark, path), uuid.uuid4().hex
    write_batch(df.withColumn(PART, F.coalesce((F.col(partition) if isinstance(partition, str) else partition).cast("string"), F.lit(""))).withColumn(FILE, F.lit(0)), path, token)
    return commit(spark, path, base, [*base.batches, token], base.dead, base.schema or df.schema.json())


def _live(df: DataFrame, spark: SparkSession, version: Version) -> DataFrame:
    df = df.where(F.col(BATCH).isin(version.batches))
    if version.dead:
        df = df.join(spark.read.parquet(version.dead), [BATCH, PART], "left_anti")
    return df


def read(spark: SparkSession, path: str, version: Version | None = None, parts: bool = False) -> DataFrame:
    """The rows of a version (the latest); with ``parts`` also their batch and partition. A table without versions is an error."""
    version = version or latest(spark, path)
    if not version.schema:
        raise ValueError(f"no version at {path}")
    schema = T.StructType([*T.StructType.fromJson(json.loads(version.schema)), T.StructField(BATCH, T.StringType()), T.StructField(PART, T.StringType()), T.StructField(FILE, T.IntegerType())])
    df = _live(spark.read.schema(schema).parquet(f"{path}/data").drop(FILE).fillna("", [PART]), spark, version)
    return df if parts else df.drop(BATCH, PART)


def files(spark: SparkSession, path: str, version: Version | None = None) -> DataFrame:
    """batch, part, file, bytes of the data files of a version, from the listing alone: no file is opened."""
    version = version or latest(spark, path)
    if not version.batches:
        return spark.createDataFrame([], f"{BATCH} string, {PART} string, file string, bytes bigint")
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{path}/data").select("path", "length")
    name = lambda c: F.url_decode(F.replace(F.regexp_extract("path", f"/{c}=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    part = F.when(name(PART) == "__HIVE_DEFAULT_PARTITION__", "").otherwise(name(PART))
    found = listed.select(name(BATCH).alias(BATCH), part.alias(PART), F.col("path").alias("file"), F.col("length").alias("bytes"))
    return _live(found, spark, version)


def vacuum(spark: SparkSession, path: str) -> Version:
    """Delete the directories that the latest version doesn't use any more. Readers of older versions must have ended."""
    base = latest(spark, path)
    if not base.dead:
        return base
    for r in spark.read.parquet(base.dead).distinct().toLocalIterator():
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(r[PART]) if r[PART] else "__HIVE_DEFAULT_PARTITION__"
        fs, p = _fs(spark, f"{path}/data/{BATCH}={r[BATCH]}/{PART}={escaped}")
        fs.delete(p, True)
    return commit(spark, path, base, base.batches, None, base.schema)
