"""Session, table loading and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def local_session(cpus: str | int = 8, app: str = "siftbase", **conf: str) -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the session's workers, once per application, so that they need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        home = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{home.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(home.rglob("*.py")):
                z.write(f, f.relative_to(home.parent))
        sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset and everything runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, so that its lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def distinct_rows(df: DataFrame, id_col: str, *columns: str) -> DataFrame:
    """``id_col`` and ``columns`` with repeated rows of one id counted once.

    Rows that agree in all the columns kept count once. A row whose id is null
    can't be recognised as a repeat and stays a row of its own.
    """
    own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
    return df.select(id_col, *columns, own.alias("_own")).distinct().drop("_own")


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever its letter case."""
    taken = {c.lower() for f in frames for c in f.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name
