"""Session defaults, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Defaults of a session that this package builds; a cluster's own settings win.
#: Columns of plans are built of thousands of calls; without tracing each to its line of Python they are built twice as fast.
DEFAULTS = {"spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}


def build(app: str = "factmill", **settings: str) -> SparkSession:
    """A session with the package's defaults and ``settings`` (dots as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_factmill_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "factmill.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._factmill_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which the whole cluster sees.

    Where it isn't set, the context's checkpoint folder; a temporary one in
    local mode only, as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set: intermediate tables need a folder that all executors share")
        folder = getattr(context, "_factmill_folder", None) or tempfile.mkdtemp()
        context._factmill_folder = folder
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(target) if at_end else system.delete(target, True)


#: Shuffle files go as soon as the table that they led to is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, **options: str | int) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read from there: its lineage is cut, and what is random in it is settled.

    ``drop`` deletes a table once nothing reads it; the others go when the
    session ends.  ``options`` are those of Spark's writer.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factmill-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _delete(spark, path, at_end=True)
    table = spark.read.schema(df.schema).parquet(path)
    table._factmill_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` wrote; nothing may read them any more."""
    for table in tables:
        if path := getattr(table, "_factmill_path", None):
            _delete(table.sparkSession, path)
