"""SparkSession settings that the library expects."""

from __future__ import annotations

import atexit
import contextlib
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings that change results (time zone, ANSI) or plans (AQE); everything else belongs to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


#: Most rows of a lookup table that is sent to all executors.
SMALL_ROWS = 100_000


def settled(frame: DataFrame) -> DataFrame:
    """The frame, computed once and for all where the session has a checkpoint folder: for small results of costly work that a plan reads several times."""
    return frame.checkpoint() if frame.sparkSession.conf.get("spark.checkpoint.dir", None) else frame


_FOLDERS: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean_up() -> None:
    """Results are read lazily while the driver's process lives; its working folders go with it, if the session still runs."""
    for spark, path in _FOLDERS:
        with contextlib.suppress(Exception):
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def working_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: in spark.checkpoint.dir, or a temporary one where a local session has none (tests). It goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sedgewren-work-')}"
    else:
        found = f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"
    _FOLDERS.append((spark, found))
    return found


def write_apart(frame: DataFrame) -> str:
    """Writes the frame to a new working folder and returns its path, which any session can read."""
    path = f"{working_folder(frame.sparkSession)}/t"
    frame.write.parquet(path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """The frame, written to a folder that executors share and read back: cuts the lineage of rounds; ``drop_stored`` deletes it."""
    path = write_apart(frame)
    read = frame.sparkSession.read.schema(frame.schema).parquet(path)
    read._sedgewren_path = path
    return read


def drop_stored(frame: DataFrame) -> None:
    """Deletes a table of ``stored`` that no later plan reads."""
    delete(frame.sparkSession, frame._sedgewren_path)


def small(frame: DataFrame) -> DataFrame:
    """Marks a lookup table for broadcasting if it has at most SMALL_ROWS rows (counted up to there); else a plain join takes it, whose skew AQE splits."""
    return F.broadcast(frame) if frame.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else frame


def configure_logging(level: str = "INFO", spark: SparkSession | None = None) -> logging.Logger:
    """The package's logger, to standard error with time, level and name; the session's level follows if one is given."""
    logger = logging.getLogger("sedgewren")
    if not logger.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(handler)
    logger.setLevel(level.upper())
    if spark is not None:
        spark.sparkContext.setLogLevel("WARN" if level.upper() == "WARNING" else level.upper())
    return logger


def build_session(name: str = "sedgewren", master: str | None = None, **more: str) -> SparkSession:
    """A session with SETTINGS; ``more`` holds further options (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
