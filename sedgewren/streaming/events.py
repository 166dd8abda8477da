"""Streams: windowed counts, sessions, deduplication, and early decisions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import working_folder  # noqa: F401 - where streams put what they write


def read_events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The events table as a stream of its files, with ts as an instant.

    All files that are there come in one micro-batch: their times may overlap, and a watermark that moved between
    them would drop rows as late. ``files`` a batch is for tables whose files come in order of time.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        # A stream's source is a folder; of this one it takes the named file alone.
        folder, _, name = path.rpartition("/")
        source = reader.option("pathGlobFilter", name).parquet(folder)
    else:
        source = reader.parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return windowed.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "6 hours") -> DataFrame:
    windowed = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return windowed.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def distinct(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once, however many batches a table comes in and however far apart its rows are. State holds all keys."""
    return events.dropDuplicates(keys)


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark's delay: state is bounded, and a key that comes again later is emitted again."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


OUT = "user_id long, predicted_label long, posts_seen long"
STATE = "seen long, streak long, decided boolean"


def early_decisions(scores: DataFrame, threshold: float = 0.5, streak: int = 1) -> DataFrame:
    """Emits a user's positive decision once, at the post that ends the first run of ``streak`` scores at the threshold.

    State is three numbers a user. Within a micro-batch posts are taken by (ts, event_id); later batches go on
    where the last ended, so the result equals the batch operator's on input in time order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, run, decided = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches))
        out = []
        if not decided:
            for score in rows.sort_values(["ts", "event_id"])["score"]:
                seen += 1
                run = run + 1 if score >= threshold else 0
                if run >= streak:
                    decided = True
                    out.append((key[0], 1, seen))
                    break
        state.update((int(seen), int(run), bool(decided)))
        yield pd.DataFrame(out, columns=["user_id", "predicted_label", "posts_seen"])

    return scores.groupBy("user_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and reads its output back; the checkpoint beside it lets a later run go on."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
