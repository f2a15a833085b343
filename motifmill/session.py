"""Session defaults and lineage cutting."""

from __future__ import annotations

import contextlib
import gc
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus="*", shuffle_partitions=8, app="motifmill", **conf) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    settings = {
        **ADAPTIVE,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a throw-away one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="motifmill-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per application.

    Python tasks unpickle functions by the name of their module, so workers have to be able to
    import the package wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    target = os.path.join(tempfile.mkdtemp(prefix="motifmill-"), "motifmill.zip")
    with open(target, "wb") as file:  # the driver serves it to the executors
        file.write(held.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that a lost executor does not replay its past."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Values at their full width: files are as large as the rows in them.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def stage(df: DataFrame, name: str = "stage", outlives_job: bool = False, by: list[str] | None = None,
          plain: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Used where a frame has several consumers: it is computed once, survives lost executors,
    is read column by column, and has a known size, by which Catalyst decides on broadcasts.
    A result that ``outlives_job`` stays when the innermost ``job`` ends, until the one around it does.
    ``by`` are columns whose values have folders of their own, so that a filter by them reads only these.
    ``plain`` is for tables of a few numbers a row that are joined to larger ones: Parquet packs millions of such rows
    into a few MB, and Catalyst, which goes by the size of files, would send them all through the driver to broadcast them.
    """
    spark = df.sparkSession
    path = _new_stage(spark, name, outlives_job)
    df.write.options(**PLAIN if plain else {}).partitionBy(*by or []).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_each(parts: Iterator[DataFrame], name: str = "stage") -> DataFrame:
    """``stage`` for a table that is made part by part; there is one part at least."""
    path = None
    for part in parts:
        path = path or _new_stage(part.sparkSession, name)
        spark, schema = part.sparkSession, part.schema
        part.write.mode("append").parquet(path)
        del part
        gc.collect()  # else the driver keeps the plans and file lists of the parts before
    return spark.read.schema(schema).parquet(path)


def _new_stage(spark: SparkSession, name: str, outlives_job: bool = False) -> str:
    path = f"{_stages_of(spark)}/{name}-{uuid.uuid4().hex}"
    jobs = _open_jobs[:-1] if outlives_job else _open_jobs
    if jobs:
        jobs[-1].append(path)
    return path


_open_jobs: list[list[str]] = []


@contextlib.contextmanager
def job(spark: SparkSession) -> Iterator[None]:
    """Drop, at the end, the tables that were staged within; results have to be written by then."""
    _open_jobs.append([])
    try:
        yield
    finally:
        for path in _open_jobs.pop():
            _delete(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as this lasts."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def _delete(spark: SparkSession, path: str) -> None:
    files, place = _place(spark, path)
    files.delete(place, True)


def _stages_of(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stages-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete this application's staged tables, once nothing reads them any more."""
    _delete(spark, _stages_of(spark))
