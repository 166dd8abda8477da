"""Collectors: one interface over sources of posts, and a Spark data source of saved listing pages, batch and stream."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.preprocess import passes_filters
from ..schemas import POST_RAW
from .files import read_dump


@dataclass(frozen=True)
class Collection:
    """What to collect: communities, and the floors of the filters."""

    communities: Sequence[str] = ()
    least_score: int = 0
    least_chars: int = 0


@dataclass(frozen=True)
class PageFiles(InputPartition):
    """Some files of pages, each with its community."""

    files: tuple[tuple[str, str], ...] = field(default=())


def plain_name(folder: str) -> str:
    """The community of a folder: its name, or the value of a name=value one."""
    return folder.partition("=")[2] or folder


class Pages:
    """Files of saved listing pages: ``path``/<community>/..., in the order of their paths. A file holds a page a line.

    Paths are URIs that pyarrow knows (file, hdfs, s3, gs) or local ones. Names that begin with a dot or
    an underscore are left out, as Spark does.
    """

    #: Files that one task reads.
    PER_TASK = 16

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the source of listing pages needs a path")
        self.path = options["path"]
        names = options.get("communities")
        self.wanted = {n.strip().lower() for n in names.split(",")} if names is not None else None
        self.per_task = int(options.get("filespertask", options.get("filesPerTask", self.PER_TASK)))

    def system(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def found(self) -> dict[str, list[str]]:
        """Paths by community, relative to its folder, ascending."""
        from pyarrow import fs

        system, root = self.system()
        out: dict[str, list[str]] = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            parts = info.path[len(root.rstrip("/")) + 1 :].split("/")
            if info.type != fs.FileType.File or len(parts) < 2 or any(p[:1] in "._" for p in parts):
                continue
            if self.wanted is None or plain_name(parts[0]).lower() in self.wanted:
                out.setdefault(parts[0], []).append("/".join(parts[1:]))
        return {folder: sorted(names) for folder, names in sorted(out.items())}

    def dealt(self, files: list[tuple[str, str]]) -> list[PageFiles]:
        return [PageFiles(tuple(files[i : i + self.per_task])) for i in range(0, len(files), self.per_task)]

    def rows(self, partition: PageFiles) -> Iterator[tuple]:
        system, root = self.system()
        for folder, name in partition.files:
            with system.open_input_stream(f"{root.rstrip('/')}/{folder}/{name}") as stream:
                text = stream.read().decode("utf-8", "replace")
            for line in text.split("\n"):
                yield from posts_of(line, plain_name(folder))


def posts_of(page: str, community: str) -> Iterator[tuple]:
    """The posts of one page in the order of POST_RAW; what cannot be read as a page has none, and children of another kind than t3 are left out."""
    try:
        children = json.loads(page)["data"]["children"]
    except (ValueError, KeyError, TypeError):
        return
    number = lambda v, kind: kind(v) if isinstance(v, int | float) and not isinstance(v, bool) else kind(0)
    words = lambda v: v if isinstance(v, str) else ""
    for child in children if isinstance(children, list) else []:
        post = child.get("data") if isinstance(child, dict) and child.get("kind") == "t3" else None
        if not isinstance(post, dict) or not post.get("id"):
            continue
        yield (
            str(post["id"]), words(post.get("subreddit")) or community, number(post.get("created_utc"), float), words(post.get("title")), words(post.get("selftext")), post["author"] if isinstance(post.get("author"), str) else None,
            number(post.get("score"), int), number(post.get("num_comments"), int), words(post.get("permalink")), bool(post.get("is_self", True)), bool(post.get("over_18", False)), "scraper", number(post.get("collected_at"), float), "submission", None,
        )


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages.dealt([(folder, name) for folder, names in self.pages.found().items() for name in names]) or [PageFiles()]

    def read(self, partition: PageFiles) -> Iterator[tuple]:
        return self.pages.rows(partition)


class ListingStream(DataSourceStreamReader):
    """New pages since the last batch. The offset is a cursor for each community: the path of its last page, so pages are to be saved under ascending names."""

    def __init__(self, options: dict[str, str]):
        self.pages = Pages(options)

    def initialOffset(self) -> dict:  # noqa: N802 (Spark's name)
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return {folder: names[-1] for folder, names in self.pages.found().items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        files = [(folder, name) for folder, names in self.pages.found().items() if folder in end for name in names if start.get(folder, "") < name <= end[folder]]
        return self.pages.dealt(files) or [PageFiles()]

    def read(self, partition: PageFiles) -> Iterator[tuple]:
        return self.pages.rows(partition)


class ListingPages(DataSource):
    """``spark.read.format("listing_pages").load(path)``, or readStream. Options: communities (comma-separated), filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> T.StructType:
        return POST_RAW

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ListingReader(dict(self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802 (Spark's name)
        return ListingStream(dict(self.options))


class Collector(ABC):
    """Posts of communities from one source. A subclass gives ``collect_communities``; filters and the rest are shared."""

    def __init__(self, spark: SparkSession, settings: Collection):
        self.spark, self.settings = spark, settings

    @abstractmethod
    def collect_communities(self, names: Sequence[str]) -> DataFrame:
        """All posts of the communities, in one scan, with at least the columns that filters need."""

    def collect_community(self, name: str) -> DataFrame:
        return self.kept(self.collect_communities([name]))

    def collect_all(self) -> DataFrame:
        """The posts of every community of the settings, filtered; each id once, whatever number of pages has it."""
        return self.kept(self.collect_communities(self.settings.communities))

    def kept(self, posts: DataFrame) -> DataFrame:
        whole = posts if "kind" in posts.columns else posts.withColumn("kind", F.lit("submission"))
        return whole.where(passes_filters(self.settings.least_score, self.settings.least_chars)).dropDuplicates(["id"])


COLLECTORS: dict[str, Callable[..., Collector]] = {}


def collector(name: str) -> Callable:
    """Registers a Collector under a name."""

    def put(make: Callable[..., Collector]) -> Callable[..., Collector]:
        COLLECTORS[name] = make
        return make

    return put


def make_collector(name: str, spark: SparkSession, settings: Collection, **options: object) -> Collector:
    if name not in COLLECTORS:
        raise ValueError(f"unknown collector {name}; there are {', '.join(sorted(COLLECTORS))}")
    return COLLECTORS[name](spark, settings, **options)


@collector("listing")
class ListingCollector(Collector):
    """Saved listing pages, as a batch or, with ``stream``, as a stream that goes on where its checkpoint ends."""

    def __init__(self, spark: SparkSession, settings: Collection, path: str):
        super().__init__(spark, settings)
        self.path = path
        spark.dataSource.register(ListingPages)

    def collect_communities(self, names: Sequence[str]) -> DataFrame:
        return self.spark.read.format("listing_pages").option("communities", ",".join(names)).load(self.path)

    def stream(self) -> DataFrame:
        """Unlike a batch, an id comes again with each page that has it."""
        posts = self.spark.readStream.format("listing_pages").option("communities", ",".join(self.settings.communities)).load(self.path)
        return posts.where(passes_filters(self.settings.least_score, self.settings.least_chars))


@collector("dump")
class DumpCollector(Collector):
    """Rows of a dump that is a frame already."""

    def __init__(self, spark: SparkSession, settings: Collection, dump: DataFrame):
        super().__init__(spark, settings)
        self.dump = dump

    def collect_communities(self, names: Sequence[str]) -> DataFrame:
        return read_dump(self.dump, names)


@collector("merged")
class MergedCollector(Collector):
    """Several collectors as one; an id that more than one has comes from the first."""

    def __init__(self, spark: SparkSession, settings: Collection, parts: Sequence[Collector]):
        super().__init__(spark, settings)
        self.parts = list(parts)

    def collect_communities(self, names: Sequence[str]) -> DataFrame:
        ranked = [p.collect_communities(names).withColumn("_rank", F.lit(i)) for i, p in enumerate(self.parts)]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
        first = F.min_by(F.struct(*[c for c in whole.columns if c != "_rank"]), "_rank")
        return whole.groupBy("id").agg(first.alias("p")).select("p.*")
