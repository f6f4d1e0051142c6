"""Session helpers: the shared folder, written intermediate tables, worker imports."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_CLAIMED: set[str] = set()
_SENT: set[str] = set()
REPO_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int | str = 8, app: str = "slicewright", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    settings = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, else one of our own for local masters."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="slicewright-")
        sc.setCheckpointDir(named)
        atexit.register(_remove_local, named)
    return named.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def new_table_path(spark: SparkSession, label: str) -> str:
    """An unused path for an intermediate table in the shared folder; it goes when the application ends."""
    base = f"{shared_dir(spark)}/slicewright/{spark.sparkContext.applicationId}"
    if base not in _CLAIMED:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _CLAIMED.add(base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step", path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, or at ``path``, and read it back.

    It cuts the lineage like a checkpoint, but is columnar and compressed, has known
    sizes, and outlives any executor.
    """
    spark = df.sparkSession
    path = path or new_table_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._slicewright_path = path
    return out


def bucketed(df: DataFrame, by: list[str], label: str = "buckets") -> DataFrame:
    """Write ``df`` hash-partitioned and sorted by ``by`` in the shared folder and read it back.

    Joins on ``by`` then take it as it lies, without a shuffle or sort of it. It has as many buckets as the
    session has shuffle partitions.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_table_path(spark, label)
    name = f"slicewright_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._slicewright_path, out._slicewright_table = path, name
    return out


def discard(spark: SparkSession, frames: Iterable[DataFrame]) -> None:
    """Delete tables written by :func:`materialize` or :func:`bucketed` that nothing will read again."""
    for df in frames:
        name = getattr(df, "_slicewright_table", None)
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = getattr(df, "_slicewright_path", None)
        if path:
            hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package: from where the driver found it, and on a cluster also from a zip sent with the jobs."""
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        _send_package(spark)
    env = sc.environment
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO_ROOT not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO_ROOT, have) if x)


def _send_package(spark: SparkSession) -> None:
    """Write the package as a zip to the shared folder, once an application, and add it to the path of the workers."""
    if spark.sparkContext.applicationId in _SENT:
        return
    import io
    import zipfile

    package, raw = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), REPO_ROOT))
    path = new_table_path(spark, "package") + ".zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(raw.getvalue())
    out.close()
    spark.sparkContext.addPyFile(path)
    _SENT.add(spark.sparkContext.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config_value(spark: SparkSession, sf_dir: str, param: str, default: str) -> str:
    """A value of ``default_config``; the table has one row per parameter."""
    from pyspark.sql import functions as F

    rows = table(spark, sf_dir, "default_config").where(F.col("param") == param).select("param_text").limit(1).collect()
    return rows[0][0] if rows and rows[0][0] is not None else default
