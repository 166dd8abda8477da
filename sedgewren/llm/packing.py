"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of these characters alone get the same ids from both libraries (their regular expressions know
#: different Unicode versions); others, and texts that spell the special token, go to ``tokenizers``.
PLAIN = re.compile("[\x00-ɏͰ-ϿЀ-ӿ‐-‧‰-⁞€]*")
SPECIAL = "<|endoftext|>"
#: On longer runs of white space the fast library's regular expressions run out of stack.
BLANKS = re.compile(r"\s{1000}")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def make_encoder(folder: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts to the ids of byte_bpe_50k.json; ``folder`` holds the vocabulary files (default: as installed)."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
    slow: list[Tokenizer] = []  # loaded for the first text that needs it
    with open(place("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_tokenizers(text: str) -> list[int]:
        if not slow:
            slow.append(Tokenizer.from_file(place("byte_bpe_50k.json")))
        return slow[0].encode(text, add_special_tokens=False).ids

    def encode(texts: list[str]) -> list[list[int]]:
        return [
            fast.encode_ordinary(t) if SPECIAL not in t and PLAIN.fullmatch(t) and not BLANKS.search(t) else by_tokenizers(t)
            for t in texts
        ]

    return encode


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0..k-1) of each item by Karmarkar-Karp multiway differencing.

    Each item starts as a partial partition of k sums. The two with the largest spreads are merged, the
    largest sum of one onto the smallest of the other, until one is left; the merges are then unrolled.
    """
    if k == 1 or len(sizes) == 1:
        return np.zeros(len(sizes), dtype=np.int64)
    sums: list[np.ndarray] = []
    for size in sizes:
        one = np.zeros(k, dtype=np.int64)
        one[0] = size
        sums.append(one)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both)
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0] - both[-1]), len(sums) - 1))
    slots: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    where = np.zeros(len(sizes), dtype=np.int64)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        own = slots.pop(len(sizes) + at)
        back = np.empty(k, dtype=np.int64)
        back[order] = own
        for child, view in ((a, back), (b, back[::-1])):
            if child < len(sizes):
                where[child] = view[0]
            else:
                slots[child] = view
    return where


def pack_block(lengths: list[int], window: int, grain: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, length) pieces for items of the given lengths.

    Whole windows are cut off each item first. What remains is cut into grains, and differencing spreads the
    grains over as few windows as could hold them; while a window exceeds its capacity, the count rises.
    """
    windows: list[list[tuple[int, int, int]]] = []
    grains: list[tuple[int, int, int]] = []
    for item, length in enumerate(lengths):
        full = length // window
        windows += [[(item, i * window, window)] for i in range(full)]
        at = full * window
        rest = length - at
        parts = -(-rest // grain)
        for p in range(parts):
            size = rest // parts + (p < rest % parts)
            grains.append((item, at, size))
            at += size
    if not grains:
        return windows
    sizes = [g[2] for g in grains]
    k = -(-sum(sizes) // window)
    while True:
        where = differencing(sizes, k)
        sums = np.bincount(where, weights=sizes, minlength=k)
        if sums.max() <= window:
            break
        k += 1
    packed: list[list[tuple[int, int, int]]] = [[] for _ in range(k)]
    for grain_, at in zip(grains, where.tolist(), strict=True):
        held = packed[at]
        if held and held[-1][0] == grain_[0] and held[-1][1] + held[-1][2] == grain_[1]:
            held[-1] = (grain_[0], held[-1][1], held[-1][2] + grain_[2])
        else:
            held.append(grain_)
    return windows + [p for p in packed if p]


def pack(docs: DataFrame, window: int = 1024, grain: int = 128, block_tokens: int = 160_000, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Packs every row's whole text (null: empty), encoded and closed with ``end_id``, into windows; a row per piece.

    There is no shuffle: each task packs the rows of its own partition in blocks of about ``block_tokens``
    tokens of remainders, so its memory is bounded by a block and the longest text. A window's id is the
    partition's number and a running one; a task that runs again gives the same. Rows that repeat are
    packed each on their own, a null id stays null, an empty table gives no rows, other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder(folder)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        ids: list[int | None] = []
        tokens: list[np.ndarray] = []
        rest = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, rest
            columns: list[list] = [[] for _ in names]
            for pieces in pack_block([len(t) for t in tokens], window, grain):
                offset = 0
                for item, start, length in pieces:
                    own = tokens[item]
                    row = (ids[item], start, length, zlib.crc32(own[start : start + length].tobytes()), len(own), serial, offset)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
                    offset += length
                serial += 1
            ids.clear()
            tokens.clear()
            rest = 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for key, own in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    own.append(end_id)
                    ids.append(key)
                    tokens.append(np.array(own, dtype="<u4"))
                    rest += len(own) % window
                    held += len(own)
                    if rest >= block_tokens or held >= 50 * block_tokens:
                        yield from flush()
                        held = 0
        if tokens:
            yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)
