"""URL rules by a cascade of Bloom filters, in DataFrame functions alone."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh

#: (verdict, host, path) of the rules of op5.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rules of one cascade, whose filters travel in the plan; more rules are dealt to several cascades by a hash of the key.
CASCADE_RULES = 50_000


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    words: tuple[int, ...]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.expr("''")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(rest)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Rule strings that would fit, of as many labels as rules may have: the host's last 1 to ``labels`` labels with every
    rule length of path. The longest come first; of equal length, the longer host. Linear in the url's length."""
    suffixes = [F.substring_index(host, ".", -n) for n in range(1, labels + 1)]
    # A host of fewer labels gives itself again and again; the first time will do.
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    keys = [
        F.when((F.length(path) >= n) & (dots >= i), F.struct((-F.length(s) - n).alias("n"), (-F.length(s)).alias("h"), F.concat(s, F.substring(path, 1, n)).alias("key")))
        for i, s in enumerate(suffixes)
        for n in lengths
    ]
    return F.transform(F.array_sort(F.array_compact(F.array(*keys))), lambda x: x["key"])


def places(key: Column, level: int, hashes: int, bits: int) -> list[Column]:
    """The bits of a key in a filter, by two hashes of 48 bits."""
    part = F.lit((1 << 48) - 1)
    first, second = (F.xxhash64(F.lit(2 * level + i), key).bitwiseAND(part) for i in (0, 1))
    return [(first + F.lit(i) * second.bitwiseOR(F.lit(1))) % F.lit(bits) for i in range(hashes)]


def passes(key: Column, number: int, level: Level) -> Column:
    # One literal, whatever the filter's size: the optimiser folds the cast once.
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    found = None
    for place in places(key, number, level.hashes, level.bits):
        bit = F.getbit(F.element_at(words, (F.shiftright(place, 6) + 1).cast("int")), (place % 64).cast("int")) == 1
        found = bit if found is None else found & bit
    return found


def holds(key: Column, levels: list[Level]) -> Column:
    """Membership: the first level that turns a key away decides; odd levels stand for 'listed after all'."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        answer = F.when(passes(key, number, levels[number]), answer).otherwise(F.lit(number % 2 == 1))
    return answer


def build_level(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """A filter of the frame's ``key`` column. Its bits are gathered by word, so the driver gets the filter alone."""
    hashes = max(1, min(24, round(-math.log2(rate))))
    bits = 64 * max(1, math.ceil(max(1, count) * hashes / math.log(2) / 64))
    marks = keys.select(F.explode(F.array(*places(F.col("key"), number, hashes, bits))).alias("at"))
    word = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    rows = marks.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(word).alias("bits")).collect()  # of one filter: a bound of its own
    words = [0] * (bits // 64)
    for row in rows:
        words[row["w"]] = row["bits"]
    return Level(bits, hashes, tuple(words))


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 40) -> list[Level]:
    """Filters whose answers are exact for every key of the universe.

    Level 0 encodes the listed keys, at a rate of about their number over twice the universe's, so that about
    half as many false positives are left as there are listed keys; level 1 encodes those, level 2 the listed
    keys that pass level 1, and so on until nothing passes wrongly. The universe is read once to be counted and
    once for level 0; later levels look only at what is left.
    """
    listed = listed.distinct()
    listed_n = listed.count()
    if not listed_n:
        return []
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    return finish_cascade(listed, listed_n, [start_cascade(listed, listed_n, size)], universe, most_levels)


def start_cascade(listed: DataFrame, listed_n: int, size: int) -> Level:
    return build_level(listed, listed_n, 0, min(0.5, listed_n / (2.0 * max(1, size))))


def finish_cascade(listed: DataFrame, listed_n: int, levels: list[Level], passed: DataFrame, most_levels: int = 40) -> list[Level]:
    """The levels after the first; ``passed`` holds at least the universe's keys that pass that one."""
    scratch = Scratch(listed.sparkSession, "cascade")
    # The false positives of level 0 are about as few as the rules; they alone are kept from the universe.
    wrong = passed.select("key").where(passes(F.col("key"), 0, levels[0])).distinct()
    wrong = scratch.put(wrong.join(F.broadcast(listed), "key", "left_anti"))
    wrong_n = wrong.count()
    inside, inside_n = listed, listed_n
    while wrong_n and len(levels) < most_levels:
        number = len(levels)
        levels.append(build_level(wrong, wrong_n, number, 0.5))
        last = levels[-1]
        # Those that were listed and now pass wrongly become what the next level encodes.
        nxt = inside.where(passes(F.col("key"), number, last))
        inside, inside_n, wrong = wrong, wrong_n, nxt
        wrong_n = wrong.count()
    if wrong_n:
        raise RuntimeError("the cascade did not end")
    return levels


def deal(key: Column, parts: int) -> Column:
    """The cascade that a key belongs to."""
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)) if parts > 1 else F.lit(0)


def holds_dealt(key: Column, cascades: list[list[Level]]) -> Column:
    """Membership in the cascade that the key is dealt to."""
    answer = F.lit(False)
    for part, levels in enumerate(cascades):
        answer = F.when(deal(key, len(cascades)) == part, holds(key, levels)).otherwise(answer) if len(cascades) > 1 else holds(key, levels)
    return answer


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", url_col: str = "url") -> DataFrame:
    """The frame with host, path, rule and verdict of each url.

    Rules of each verdict are one cascade over all keys of all urls; a url takes its longest listed key (of
    equal length, the one with the longer host), and ``default`` without one: a key that no cascade lists is
    exactly that, not listed. Null and odd urls have an empty host and path, fit no rule, and take the default.
    Of a rule that is given as both, block counts. The urls are read three times: to count their keys, to find those
    that pass a first level, and to be judged. Columns of the frame named like the new ones are replaced.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = split_url(F.col(url_col).cast("string"))
    lengths = sorted({len(p) for _, _, p in rules}) or [1]
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    keys_of, hit = fresh([*pages.columns, "host", "path", "rule", "verdict"], 2)
    wide = pages.withColumns({"host": host, "path": path}).withColumn(keys_of, F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(candidate_keys(F.col("host"), F.col("path"), labels, lengths)))
    blocked = {h + p for v, h, p in rules if v == "block"}
    wanted = [("block", blocked), ("allow", {h + p for v, h, p in rules if v == "allow"} - blocked)]
    cascades: dict[str, list[list[Level]]] = {"block": [], "allow": []}
    listed, first = [], []
    keys = pages.where(F.instr(F.col(url_col).cast("string"), "://") > 0).select(F.explode(candidate_keys(host, path, labels, lengths)).alias("key"))
    size = keys.agg(F.approx_count_distinct("key")).first()[0] if rules else 0
    for kind, words in wanted:
        parts = -(-len(words) // CASCADE_RULES)
        whole = spark.createDataFrame([(k,) for k in sorted(words)], "key string") if words else None
        for part in range(parts):
            own = scratch.put(whole.where(deal(F.col("key"), parts) == part))
            count = own.count()
            if count:
                first.append(start_cascade(own, count, size))
                listed.append((kind, part, parts, own, count))
            cascades[kind].append([])
    if listed:
        # One pass over the urls keeps what passes some cascade's first level: the rules' keys, and about half as many more.
        tests = [(deal(F.col("key"), parts) == part) & passes(F.col("key"), 0, level) for (_, part, parts, _, _), level in zip(listed, first, strict=True)]
        passed = scratch.put(keys.where(reduce(lambda a, b: a | b, tests)).distinct())
        for (kind, part, parts, own, count), level in zip(listed, first, strict=True):
            cascades[kind][part] = finish_cascade(own, count, [level], passed.where(deal(F.col("key"), parts) == part))

    def verdict(key: Column) -> Column:
        return F.when(holds_dealt(key, cascades["block"]), F.lit("block")).when(holds_dealt(key, cascades["allow"]), F.lit("allow"))

    judged = F.transform(keys_of, lambda k: F.struct(k.alias("rule"), verdict(k).alias("verdict")))
    first = F.get(F.filter(judged, lambda x: x["verdict"].isNotNull()), 0)
    return wide.withColumn(hit, first).withColumns({"rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["verdict"], F.lit(default))}).drop(keys_of, hit)
