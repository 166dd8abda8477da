"""Cohorts of users: disclosed ones, matched controls, test posts, held-out marks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_stored, stored


def disclosed(frame: DataFrame, user: str, flags: Sequence[str]) -> DataFrame:
    """(user, one 0/1 column for each flag): whether any of a user's rows has it. Null and empty users are left out."""
    kept = frame.where(F.col(user).isNotNull() & (F.col(user).cast("string") != ""))
    return kept.groupBy(user).agg(*[F.max(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags])


def user_table(frame: DataFrame, user: str, community: str, flags: dict[str, str]) -> DataFrame:
    """A row per user: user_<target> flags, the group's name, rows, and the sorted communities joined by commas."""
    kept = frame.where(F.col(user).isNotNull() & (F.col(user).cast("string") != ""))
    agg = kept.groupBy(user).agg(
        *[F.max(F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(f"user_{t}") for t, c in flags.items()], F.count("*").alias("n_posts"),
        F.array_join(F.sort_array(F.collect_set(F.col(community).cast("string"))), ",").alias("subreddits"),
    )
    names = F.concat_ws("+", *[F.when(F.col(f"user_{t}") == 1, F.lit(t)) for t in flags])
    group = F.when(names != "", F.concat(F.lit("disclosed_"), names)).otherwise("matched_control")
    return agg.withColumn("user_group", group).select(user, *[f"user_{t}" for t in flags], "user_group", "n_posts", "subreddits")


def control_pool(frame: DataFrame, user: str, community: str, flags: Sequence[str], min_posts: int = 3) -> DataFrame:
    """(user, community) of users who never disclosed and have enough rows."""
    kept = frame.where(F.col(user).isNotNull())
    none = " and ".join(f"{f} = 0" for f in flags)
    users = kept.groupBy(user).agg(F.count("*").alias("n"), *[F.max(F.coalesce(F.col(f).cast("long"), F.lit(0))).alias(f) for f in flags]).where(f"n >= {min_posts} and {none}").select(user)
    return kept.select(user, F.col(community)).distinct().join(users, user, "left_semi")


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def placed(rows: DataFrame, group: str, who: str, name: str, seed: int, weight: Column | None = None) -> DataFrame:
    """Adds ``name``: the rows (or sum of weights) before this one in its group, by hash and then by ``who``.

    Groups are cut into 4,096 ranges of the hash; ranges are summed up, and rows ordered within a range only, so a
    large group is not one window.
    """
    wide = rows.withColumn("_h", hash_order(F.col(who), seed)).withColumn("_part", F.substring("_h", 1, 3)).withColumn("_w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    sums = wide.groupBy(group, "_part").agg(F.sum("_w").alias("_s"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(group, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(group, "_part").orderBy("_h", who).rowsBetween(Window.unboundedPreceding, -1)
    own = wide.withColumn(name, F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    return own.join(offsets, [group, "_part"]).withColumn(name, F.col(name) + F.col("_o")).drop("_h", "_part", "_w", "_o")


def matched_controls(frame: DataFrame, user: str, community: str, flag: str, flags: Sequence[str], per_positive: int = 2, min_posts: int = 3, seed: int = 42) -> DataFrame:
    """(positive, control, community): controls for each positive from any of its communities, each user at most once.

    In rounds: a positive that still needs controls asks in the first of its communities (by hash) where a user
    is free; a free user offers itself in the first of its communities (by hash) that is asked. Within a
    community the places of asks, as wide as their need, meet the places of offers. Rounds end when no positive in need shares a
    community with a free user, so nobody goes short while a control is left, as in a pass over positives one by one.
    Each round serves at least one ask of each community with an offer; tables of the round are written and the last ones
    deleted. Null communities match nothing.
    """
    positives = frame.where(F.col(user).isNotNull() & (F.coalesce(F.col(flag).cast("long"), F.lit(0)) == 1)).select(user).distinct()
    order = hash_order(F.concat_ws("|", F.col(user).cast("string"), F.col(community).cast("string")), seed)
    edges = lambda rows: rows.where(F.col(community).isNotNull()).select(user, F.col(community).alias("c"), order.alias("h"))
    own = stored(edges(frame.select(user, community).distinct().join(positives, user, "left_semi")))
    free = stored(edges(control_pool(frame, user, community, flags, min_posts)))
    need = stored(own.select(user).distinct().withColumn("need", F.lit(per_positive).cast("long")))
    first = F.min(F.struct("h", "c")).getField("c").alias("c")
    rounds = []
    while True:
        asks = own.join(need, user).join(free.select("c").distinct(), "c", "left_semi").groupBy(user, "need").agg(first)
        asks = stored(placed(asks.withColumnRenamed(user, "positive"), "c", "positive", "start", seed, F.col("need")))
        if asks.isEmpty():
            break
        offers = free.join(asks.select("c").distinct(), "c", "left_semi").groupBy(user).agg(first)
        offers = placed(offers.withColumnRenamed(user, "control"), "c", "control", "place", seed)
        wanted = asks.select("positive", "c", F.explode(F.sequence("start", F.col("start") + F.col("need") - 1)).alias("place"))
        got = stored(wanted.join(offers, ["c", "place"]).select("positive", "control", F.col("c").alias("community")))
        rounds.append(got)
        served = got.groupBy(F.col("positive").alias(user)).agg(F.count("*").alias("_got"))
        left = need.join(served, user, "left").select(user, (F.col("need") - F.coalesce("_got", F.lit(0))).alias("need")).where("need > 0")
        gone = got.select(F.col("control").alias(user))
        before = (need, free, asks)
        need, free = stored(left), stored(free.join(gone, user, "left_anti"))
        for table in before:
            drop_stored(table)
    empty = frame.sparkSession.createDataFrame([], f"positive {frame.schema[user].dataType.simpleString()}, control {frame.schema[user].dataType.simpleString()}, community {frame.schema[community].dataType.simpleString()}")
    return reduce(DataFrame.unionByName, rounds, empty)


def test_users(frame: DataFrame, user: str, community: str, flags: dict[str, str], per_positive: int = 2, min_posts: int = 3, seed: int = 42) -> DataFrame:
    """The user table of disclosed users and the controls matched to each target's positives."""
    table = user_table(frame, user, community, flags)
    chosen = None
    for number, column in enumerate(flags.values()):
        part = matched_controls(frame, user, community, column, list(flags.values()), per_positive, min_posts, seed + number).select(F.col("control").alias(user))
        chosen = part if chosen is None else chosen.union(part)
    positive = table.where(F.col("user_group") != "matched_control").select(user)
    return table.join(positive.union(chosen).distinct(), user, "left_semi")


def regroup(frame: DataFrame, cohort: DataFrame, user: str, community: str, flags: dict[str, str]) -> DataFrame:
    """The user table of the cohort alone; a cohort user without rows is a control with none."""
    within = user_table(frame.join(cohort.select(user).distinct(), user, "left_semi"), user, community, flags)
    zeros = {f"user_{t}": 0 for t in flags} | {"user_group": "matched_control", "n_posts": 0, "subreddits": ""}
    return cohort.select(user).where(F.col(user).isNotNull() & (F.col(user).cast("string") != "")).distinct().join(within, user, "left").fillna(zeros)


def test_posts(frame: DataFrame, users: DataFrame, user: str, flags: dict[str, str]) -> DataFrame:
    """All rows of the users, with the users' labels and whether the row itself is a disclosure."""
    labels = users.select(user, *[f"user_{t}" for t in flags], "user_group")
    own = F.greatest(F.lit(0), *[F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in flags.values()])
    return frame.join(labels, user).withColumn("is_disclosure_post", own.cast("long"))


def mark_held_out(frame: DataFrame, users: DataFrame, user: str) -> DataFrame:
    """Adds held_out_split: whether the row's user is one of the users (an existence join)."""
    keys = users.select(F.col(user).alias("_u")).distinct().withColumn("_hit", F.lit(True))
    return frame.join(keys, F.col(user) == F.col("_u"), "left").withColumn("held_out_split", F.coalesce("_hit", F.lit(False))).drop("_u", "_hit")
