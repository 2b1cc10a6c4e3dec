"""Session construction, shared-folder materialisation and table access."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "kinforge", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings every kinforge plan assumes (UTC, AQE on).

    Cluster-level sizes (executors, shuffle partitions) are left to the
    submitter; ``conf`` overrides anything here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | {k: str(v) for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a temporary folder of the
    driver, set as the checkpoint folder; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="kinforge-", dir=os.environ.get("KINFORGE_TMP"))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it reread.

    This cuts the lineage in a way that survives the loss of any executor and
    lets later stages prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kinforge/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark reaches; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark.sparkContext._jsc.sc().hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(place)) if fs.exists(place) else []


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that no later plan reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(path))
            place.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).delete(place, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished rounds deleted now, not when the driver next collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def stamp(*frames: DataFrame) -> tuple:
    """Name and time of change of the files that tables are read from."""
    found = []
    for df in frames:
        for name in sorted(df.inputFiles()):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.sparkSession._jvm.java.net.URI(name))
            status = place.getFileSystem(df.sparkSession._jsc.sc().hadoopConfiguration()).getFileStatus(place)
            found.append((name, status.getModificationTime(), status.getLen()))
    return tuple(found)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
