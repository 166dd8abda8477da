"""Files in and out: parquet, JSON lines (plain or zstd), CSV, and dumps of posts."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) leads anywhere, in any store that Spark reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def spread(frame: DataFrame) -> DataFrame:
    """Deals a scan of fewer partitions than there are cores (a file or two) out to all of them; larger ones stay as they are."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def read_shards(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All shards by name; columns that some lack are null there."""
    whole = None
    for path in paths:
        part = spark.read.parquet(path)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError("no shards")
    return whole


def read_corpus(spark: SparkSession, folder: str, whole: str = "_all.parquet") -> DataFrame:
    """The combined file if there is one, else all shards of the folder."""
    if exists(spark, f"{folder}/{whole}"):
        return spark.read.parquet(f"{folder}/{whole}")
    return spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(folder)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; malformed and blank ones are dropped. Give the schema: inference would read all twice."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def stream_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_zst_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, chunk: int = 1 << 24, window: int = 1 << 31) -> DataFrame:
    """zstd JSON lines. Each file is decoded in its task chunk by chunk (zstd frames of a dump cannot be split); lines go on as text and are parsed by Spark."""
    names = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for content in batch.column(1).to_pylist():
                rest = b""
                reader = zstandard.ZstdDecompressor(max_window_size=window).stream_reader(io.BytesIO(content), read_across_frames=True)
                while part := reader.read(chunk):
                    *whole, rest = (rest + part).split(b"\n")
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in whole if w.strip()], pa.string())], ["line"])
                if rest.strip():
                    yield pa.RecordBatch.from_arrays([pa.array([rest.decode("utf-8", "replace")], pa.string())], ["line"])

    text = names.mapInArrow(lines, "line string")
    parsed = text.select(F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null").select("r.*").dropna("all")


def write_zst_jsonl(frame: DataFrame, path: str, level: int = 3) -> None:
    """JSON lines in zstd files, one for each partition, in a folder of a file system that pyarrow knows. A task that runs again writes its file anew; a folder that has files already raises."""
    from pyarrow import fs

    target = fs.FileSystem.from_uri(path)
    target[0].create_dir(target[1], recursive=True)
    if any(i.type == fs.FileType.File for i in target[0].get_file_info(fs.FileSelector(target[1]))):
        raise FileExistsError(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        system, root = fs.FileSystem.from_uri(path)
        context = TaskContext.get()
        name = f"{root}/part-{context.partitionId():05}.jsonl.zst"
        draft, rows = f"{root}/_{context.taskAttemptId()}.tmp", 0
        with system.open_output_stream(draft, compression=None) as out, zstandard.ZstdCompressor(level=level).stream_writer(out, closefd=False) as packed:
            for batch in batches:
                rows += batch.num_rows
                packed.write("".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode())
        system.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    frame.select(F.to_json(F.struct(*frame.columns)).alias("line")).mapInArrow(write, "rows long").agg(F.sum("rows")).collect()


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_dump(frame: DataFrame, communities: Sequence[str]) -> DataFrame:
    """The rows of some communities, whatever their case, in one scan for all of them, cast to the canonical types."""
    kept = frame.where(F.lower("subreddit").isin([c.lower() for c in communities]))
    return kept.select(
        F.col("id").cast("string"), "subreddit", F.col("created_utc").cast("double"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("selftext", F.lit("")).alias("body"), "author", F.coalesce(F.col("score").cast("long"), F.lit(0)).alias("score"),
        F.coalesce(F.col("num_comments").cast("long"), F.lit(0)).alias("num_comments"), F.coalesce("permalink", F.lit("")).alias("permalink"), F.coalesce(F.col("is_self").cast("boolean"), F.lit(True)).alias("is_self"), F.coalesce(F.col("over_18").cast("boolean"), F.lit(False)).alias("over_18"), F.lit("dump").alias("source"),
    )


def write_parquet(frame: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    """Overwrites a folder; give another than the plan reads."""
    writer = frame.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_report_csv(frame: DataFrame, path: str) -> None:
    """One CSV file of a small report."""
    frame.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def dump_json(frame: DataFrame, path: str) -> None:
    """One JSON file, an array of objects, of a small report."""
    rows = frame.agg(F.to_json(F.collect_list(F.struct(*frame.columns))).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def append(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def upsert(new: DataFrame, prior: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The new rows, and the prior ones whose key is not among them."""
    return new.unionByName(prior.join(new.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def not_yet_done(frame: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in a table of finished ones: resuming, and a cache of answers, as an anti join."""
    return frame.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cache_key(*columns: str) -> F.Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
