"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import re
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # a repeated JSON field keeps its last value instead of voiding the message
    "spark.sql.variant.allowDuplicateKeys": "true",
}

_shipped: set[str] = set()
_tables: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables", default=None)


def build_session(app: str = "curbside", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="curbside-")
        # the driver serves the file as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(os.path.join(folder, "curbside.zip"), "w") as archive:
            for place, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(place, name)
                        archive.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(os.path.join(folder, "curbside.zip"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="curbside-"))
    return spark.conf.get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder. It goes away with the application or with ``scratch_scope``."""
    path = f"{shared_dir(spark)}/curbside/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    fs, hadoop_path = _hadoop(spark, path)
    fs.deleteOnExit(hadoop_path)
    scope = _tables.get()
    if scope is not None:
        scope.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage in a way that outlives executors, and unlike a checkpoint the file gives Catalyst the real
    size, so that its choice of a broadcast rests on what was written.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession):
    """Remove the staged tables made inside the block, for jobs that never end such as streams."""
    token = _tables.set([])
    try:
        yield
    finally:
        made = _tables.get()
        _tables.reset(token)
        for path in made:
            fs, hadoop_path = _hadoop(spark, path)
            fs.delete(hadoop_path, True)


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path
