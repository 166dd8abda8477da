"""SimHash fingerprints and near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, components, fresh

SEED = 42
#: Shingles whose bits are counted at once; bounds a task's memory for very long texts.
BLOCK = 1 << 15


def majority(hashes: np.ndarray, planes: int = 1) -> list[int]:
    """Signed 64-bit words; bit j of a word is 1 if over half the hashes have it set."""
    words = []
    for plane in range(planes):
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), BLOCK):
            part = hashes[at : at + BLOCK]
            if plane:  # a further, independent hash of each shingle
                part = (part ^ np.uint64(0x9E3779B97F4A7C15 * plane & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                part = (part ^ (part >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                part ^= part >> np.uint64(32)
            counts += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = np.packbits(counts * 2 > len(hashes))
        words.append(int.from_bytes(bits.tobytes(), "big", signed=True))
    return words


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included; one of all words if there are fewer."""
    # bytes.lower() and bytes.split() know ASCII alone: A-Z, and the white space 0x20, 0x09-0x0D.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - size + 1)
    return np.fromiter((digest(b" ".join(words[i : i + size]), SEED) for i in range(last)), dtype=np.uint64, count=last)


def fingerprint_words(text: str | None, size: int, planes: int = 1) -> list[int]:
    """The fingerprint as signed 64-bit words; all zero without words."""
    hashes = shingle_hashes(text, size)
    return majority(hashes, planes) if len(hashes) else [0] * planes


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit SimHash of each row's whole text; a null text counts as empty (fingerprint zero)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [fingerprint_words(t, shingle)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "id long, fp long")


#: Segments of a fingerprint: (lowest bit, radius of the ball that is looked up). If two fingerprints differ in two
#: bits or fewer, they differ in at most one bit of the first segment, or in none of the second.
SEGMENTS = ((0, 1), (32, 0))
#: Fingerprints of one segment value that are compared by the table; hotter values go by whole-fingerprint balls.
HOT = 64


def segment(fp: Column, low: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit(0xFFFFFFFF))


def ball(value: Column, radius: int, bits: int, low: int = 0) -> Column:
    """All values at most ``radius`` (0 or 1) flips of the ``bits`` bits from ``low`` away."""
    one = F.lit(1).cast("long")
    return F.array(value, *[value.bitwiseXOR(F.shiftleft(one, low + bit)) for bit in range(bits if radius else 0)])


def near_links(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v): links among distinct fingerprints (rep, fp) at distance two or less, enough to connect all that are linked.

    Multi-index hashing: a table for each segment holds each fingerprint once under the segment's value. A
    fingerprint enumerates the Hamming ball of its own value, fetches what the table holds under each, and the
    complete distances are verified. Values that over HOT fingerprints share (texts alike in all but a few
    shingles) are left out of that; the fingerprints that hold or look up such a value enumerate the ball of
    radius one of the whole fingerprint instead, whose members meet in a key between them: no key has more
    than 65, so no group of the size of a hot value comes together, and no link is lost.
    """
    known = reps.where("rep is not null").select("rep", "fp")
    fp = F.col("fp")
    table = [known.select("rep", "fp", F.lit(n).alias("seg"), segment(fp, low).alias("key")) for n, (low, _) in enumerate(SEGMENTS)]
    table = reduce(DataFrame.unionByName, table)
    asked = [known.select(F.col("rep").alias("a"), F.col("fp").alias("fa"), F.lit(n).alias("seg"), F.explode(ball(segment(fp, low), radius, 32)).alias("key")) for n, (low, radius) in enumerate(SEGMENTS)]
    asked = reduce(DataFrame.unionByName, asked)
    counts = table.groupBy("seg", "key").agg(F.count("*").alias("n"))
    hot = scratch.put(counts.where(F.col("n") > HOT).select("seg", "key"))
    if hot.isEmpty():
        cold, rest = table, None
    else:
        cold = table.join(hot.hint("merge"), ["seg", "key"], "left_anti")
        rest = asked.join(hot.hint("merge"), ["seg", "key"], "left_semi").groupBy("a").agg(F.first("fa").alias("fa")).select(F.col("a").alias("rep"), F.col("fa").alias("fp"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fa"))) <= 2
    links = asked.join(cold.hint("merge"), ["seg", "key"]).where((F.col("a") != F.col("rep")) & near).select(F.greatest("a", "rep").alias("u"), F.least("a", "rep").alias("v"))
    if rest is not None:
        met = rest.select("rep", "fp", F.explode(ball(fp, 1, 64)).alias("key")).groupBy("key").agg(F.collect_list(F.struct("rep", "fp")).alias("all")).where("size(all) > 1")
        pairs = met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a.rep <> b.rep and bit_count(a.fp ^ b.fp) <= 2")
        links = links.unionByName(pairs.select(F.col("b.rep").alias("u"), F.col("a.rep").alias("v")))
    return links.distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, fp, component_id), linked at two or fewer differing bits.

    Rows with the same fingerprint are one node from the start, so a group of copies costs one row however
    large it is. A null id keeps its row; it never names a component (its group's smallest known id does,
    or null). An empty table gives an empty result. Other columns of ``docs`` are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    own = scratch.put(fingerprints(docs, shingle, id_col, text_col))
    reps = scratch.put(own.groupBy("fp").agg(F.min("id").alias("rep")))
    links = scratch.put(near_links(reps, scratch))
    found = components(links, scratch)
    named = scratch.put(
        reps.join(found, reps.rep == found.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    )
    return own.join(named.hint("merge"), "fp", "left").select("id", "fp", "component_id")


#: Lookup: so many keys of so many least hashes of the shingles. Texts alike to J share a key with a chance of
#: 1 - (1 - J^4)^24, whatever the edits: all but 3 in a million at 0.8.
BANDS, BAND_ROWS = 24, 4
_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
#: Shingle sets (five words) alike to this much are near copies.
ALIKE = 0.8
#: A text of n shingles can be alike only to texts of ALIKE * n shingles or more; their sizes fall into classes that grow by this factor.
STEP = 1.03
#: Rows of a key that meet their hub in one task.
TILE = 512
#: Taken off before a double is rounded up, so that no bound comes out one too high.
SLACK = 1e-6


def short_fingerprint(hashes: np.ndarray) -> int:
    """A signed 64-bit word: bit j is 1 if over half the hashes' derived words have it set."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        x = hashes[at : at + BLOCK] ^ np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(np.int64)[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys: each a hash of the least values of BAND_ROWS functions over all the hashes, and of the band."""
    low = np.full(BANDS * BAND_ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        low = np.minimum(low, ((hashes[at : at + 1024, None] ^ _MIX[0]) * (_MIX[1] | np.uint64(1))).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the distinct shingles, ascending; none without words."""
    return np.unique(shingle_hashes(text, shingle))


def sketches(text: str | None, shingle: int) -> tuple[int, np.ndarray, int, int]:
    """A number of the words in order; the lookup keys, the fingerprint and the count of the distinct shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    whole = xxhash.xxh64_intdigest(b" ".join(words), SEED) - (1 << 63)
    own = shingle_set(text, shingle)
    if not len(own):
        return whole, np.zeros(BANDS, np.int64), 0, 0
    return whole, band_keys(own), short_fingerprint(own), len(own)


def at_least(share: float, n: Column) -> Column:
    """``share`` of ``n``, rounded up."""
    return F.ceil(F.lit(share) * n - SLACK).cast("int")


def shared_least(a: Column, b: Column) -> Column:
    """How many shingles two sets of these sizes share if they are alike to ALIKE or more."""
    return at_least(ALIKE / (1 + ALIKE), a + b)


def size_class(size: Column) -> Column:
    return F.floor(F.log(size) / np.log(STEP)).cast("int")


def prefix_rows(sets: DataFrame) -> DataFrame:
    """(hash, class, whole, size, place, own): the shingles by which texts of ``sets`` (whole, hashes) can meet all that are alike to them.

    Shingles have one order, rarest first. If two sets share m shingles, then one of those stands in the first n - m + 1
    of either set (n its size), and m follows from the sizes: so a set stands under its first shingles, the more of them the
    smaller the other set may be. Classes are of the smaller set's size, and ``own`` rows are those of a set's own class.
    Shingles that no other text has only count: a text that shares none of its first shingles has no row at all.
    """
    words = sets.select("whole", F.explode("hashes").alias("hash"))
    often = words.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    order = words.join(often.hint("merge"), "hash").groupBy("whole").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("order"))
    size, low = F.col("size"), at_least(ALIKE, F.col("size"))
    rows = sets.select("whole", F.size("hashes").alias("size")).join(order.hint("merge"), "whole").withColumn("alone", size - F.size("order"))
    first = F.slice("order", 1, F.greatest(F.lit(0), size - low + 1 - F.col("alone")))
    rows = rows.select("whole", "size", "alone", F.posexplode(first).alias("at", "word")).select("whole", "size", F.col("word.hash").alias("hash"), (F.col("alone") + F.col("at")).alias("place"))
    rows = rows.withColumn("class", F.explode(F.sequence(size_class(low), size_class(size))))
    other = F.greatest(low, F.ceil(F.pow(F.lit(STEP), F.col("class")) - SLACK).cast("int"))
    return rows.where(F.col("place") <= size - shared_least(size, other)).withColumn("own", F.col("class") == size_class(size))


def near_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, whole, component_id) of each row with an id: groups of texts whose word shingles are alike to ALIKE or more.

    Equal word sequences are one text from the start. SimHash fingerprints (64 bits) within two bits are looked up first,
    by Hamming balls (``near_links``). Copies at 0.8 differ in more bits than balls reach, so each distinct text also has
    BANDS lookup keys of its shingles' least hashes, and texts that share a key may be alike. The exact Jaccard similarity
    of their shingle sets decides on all pairs that are compared. Pairs that are one group already need no comparison: each key's
    texts are compared with its hub first, the text that shares keys with most others. What is then in keys of several groups
    meets by its rarest shingles (``prefix_rows``), which loses no pair at ALIKE: again with a hub first, then all pairs of
    different groups that sizes and places allow. Texts that share a passage and differ in more than ALIKE allows stand under
    rare shingles of their own, so they make no pairs, however many they are. ``raw`` is
    xxhash64 of the text and ``whole`` one of its words in order, which tell rows of one id apart. A null text is empty; all empty texts are copies.
    """
    scratch = Scratch(docs.sparkSession, "near-copies")
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("raw"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                done = [sketches(t, shingle) for t in part.column(1).to_pylist()]
                keys = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([d[1] for d in done])), BANDS)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *[pa.array([d[i] for d in done], pa.int64()) for i in (0, 3)], keys.cast(pa.list_(pa.int64())), pa.array([d[2] for d in done], pa.int64())], ["doc_id", "raw", "whole", "size", "keys", "fp"])

    own = scratch.put(texts.mapInArrow(work, "doc_id long, raw long, whole long, size long, keys array<long>, fp long"))
    reps = scratch.put(own.groupBy("whole").agg(F.min(F.struct("doc_id", "raw")).alias("rep"), *[F.any_value(c).alias(c) for c in ("size", "keys", "fp")]).select("whole", "rep.*", "size", "keys", "fp"))
    keys = reps.where("size > 0").select("whole", F.explode("keys").alias("key"))
    sizes = scratch.put(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int")))
    met = scratch.put(keys.join(sizes.hint("merge"), "key").select("key", "n", "parts", "whole", F.pmod(F.xxhash64("whole"), F.col("parts").cast("long")).cast("int").alias("part")))
    # The named lookup: multi-index hashing by Hamming balls of the first 64 bits; equal fingerprints point to the first of them.
    prints = reps.where("size > 0").select("whole", "fp")
    firsts = scratch.put(prints.groupBy("fp").agg(F.min("whole").alias("rep")))
    same = prints.join(firsts.hint("merge"), "fp").where("whole <> rep").select(F.col("whole").alias("u"), F.col("rep").alias("v"))
    balls = scratch.put(near_links(firsts, scratch).union(same))
    asked = balls.select(F.explode(F.array("u", "v")).alias("whole")).union(met.select("whole"))
    meeting = asked.groupBy("whole").agg(F.count("*").alias("_n")).select("whole")
    places = meeting.join(reps.select("whole", "doc_id", "raw").hint("merge"), "whole")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, shingle).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["whole", "hashes"])

    # Rows that repeat under one id hold the same text; the first of them will do.
    once = texts.join(places.hint("merge"), ["doc_id", "raw"]).select("whole", "text").groupBy("whole").agg(F.first("text").alias("text"))
    sets = scratch.put(once.mapInArrow(sets_of, "whole long, hashes array<long>"))

    def verified(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("whole").alias("u"), F.col("hashes").alias("a")).hint("merge"), "u")
        both = left.join(sets.select(F.col("whole").alias("v"), F.col("hashes").alias("b")).hint("merge"), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return both.where(shared / (F.size("a") + F.size("b") - shared) >= ALIKE).select("u", "v")

    def with_groups(rows: DataFrame) -> DataFrame:
        found = rows.join(groups.hint("merge"), rows.whole == groups.node, "left")
        return found.select(*[rows[c] for c in rows.columns], F.coalesce("component", rows.whole).alias("group"))

    def of_several(rows: DataFrame, *key: str) -> DataFrame:
        """The rows of those keys whose texts are of several groups."""
        rows = scratch.put(rows)
        several = rows.groupBy(*key).agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least <> most").select(*key)
        return rows.join(several.hint("merge"), list(key), "left_semi")

    links = scratch.put(verified(balls))
    groups = scratch.put(components(links, scratch))
    state = of_several(with_groups(met), "key")
    weights = met.groupBy("whole").agg(F.sum("n").alias("weight"))
    state = scratch.put(state.join(weights.hint("merge"), "whole"))
    hubs = state.groupBy("key", "parts").agg(F.max(F.struct("weight", "whole", "group")).alias("hub"))
    hubs = hubs.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hub")
    near = state.join(hubs.hint("merge"), ["key", "part"]).where("group <> hub.group")
    sure = scratch.put(verified(near.select(F.greatest("whole", "hub.whole").alias("u"), F.least("whole", "hub.whole").alias("v")).distinct()))
    links = links.union(sure)
    groups = scratch.put(components(links, scratch))
    left = of_several(with_groups(met), "key").groupBy("whole").agg(F.count("*").alias("_n")).select("whole")
    rows = scratch.put(prefix_rows(scratch.put(sets.join(left.hint("merge"), "whole"))))
    for hub in (True, False):
        state = scratch.put(of_several(with_groups(rows), "hash", "class"))
        one = F.struct("place", "whole", "size", "group")
        ones = state.where("own").groupBy("hash", "class").agg(F.min(one).alias("one")) if hub else state.where("own").select("hash", "class", one.alias("one"))
        shared = shared_least(F.col("size"), F.col("one.size"))
        fits = (F.col("group") != F.col("one.group")) & (F.least("size", "one.size") >= at_least(ALIKE, F.greatest("size", "one.size")))
        fits = fits & (F.col("place") <= F.col("size") - shared) & (F.col("one.place") <= F.col("one.size") - shared)
        one, many = ones.alias("a"), state.alias("b")
        near = one.hint("merge").join(many, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.class") == F.col("b.class")) & fits)
        near = scratch.put(near.select(F.greatest("whole", "one.whole").alias("u"), F.least("whole", "one.whole").alias("v")).distinct())
        sure = scratch.put(verified(near))
        if not sure.isEmpty():
            links = links.union(sure)
            groups = scratch.put(components(links, scratch))
    linked = reps.select("whole", "doc_id").join(groups.hint("merge"), F.col("whole") == F.col("node"))
    linked = scratch.put(linked.select("whole", "doc_id", "component"))
    named = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = scratch.put(linked.join(named.hint("merge"), "component").select("whole", "component_id"))
    named = scratch.put(reps.select("whole", "doc_id").join(named.hint("merge"), "whole", "left").select("whole", F.coalesce("component_id", "doc_id").alias("component_id")))
    return own.select("doc_id", "raw", "whole").join(named.hint("merge"), "whole").select("doc_id", "raw", "whole", "component_id")


def drop_copies(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows without near copies: of each group the row with the smallest id stays, one if it repeats.

    Rows with a null id belong to no group and stay. Of rows that repeat id and text, the one whose other columns come
    first in order stays. A null text is empty. Other columns may have any names.
    """
    scratch = Scratch(docs.sparkSession, "drop-copies")
    names = docs.columns
    key, raw, count = fresh(names, 3)
    groups = near_copies(docs, shingle, id_col, text_col)
    # Rows that repeat, or differ in case and white space alone, stay once; other texts under one id are others.
    chosen = groups.where("doc_id = component_id").groupBy("doc_id", "whole").agg(F.count("*").alias("n"), F.min("raw").alias("raw"))
    chosen = scratch.put(chosen.select(F.col("doc_id").alias(key), F.col("raw").alias(raw), F.col("n").alias(count)))
    on = (F.col(id_col).cast("long") == F.col(key)) & (F.xxhash64(text_col) == F.col(raw))
    kept = docs.where(F.col(id_col).isNotNull()).join(chosen.hint("merge"), on).select(*names, key, raw, count)
    once = kept.where(F.col(count) == 1).select(*names)
    rest = [name for name in names if not isinstance(docs.schema[name].dataType, T.MapType | T.VariantType)]
    more = kept.where(F.col(count) > 1).groupBy(key, raw).agg(F.min_by(F.struct(*names), F.struct(*rest)).alias(count)).select(f"{count}.*")
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))
