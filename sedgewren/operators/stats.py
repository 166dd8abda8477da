"""Effect sizes, rank tests, corrections, paired tests, resampling, and temperature scaling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import numbered_md5
from .ordered import running


def long_features(frame: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(feature, y, v): one row for each value, so that all features are compared by one plan."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as double)" for f in features)
    return frame.selectExpr(f"`{label}` as y", f"stack({len(features)}, {pairs}) as (feature, v)")


def cohens_d(frame: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Means of both classes and the standardised difference (0 without spread, null under two rows of a class)."""
    rows = long_features(frame, label, features)
    one, zero = F.when(F.col("y") == 1, F.col("v")), F.when(F.col("y") == 0, F.col("v"))
    agg = rows.groupBy("feature").agg(
        F.count(one).alias("n_pos"), F.count(zero).alias("n_neg"), F.avg(one).alias("mean_pos"), F.avg(zero).alias("mean_neg"), F.var_samp(one).alias("_v1"), F.var_samp(zero).alias("_v0"),
    )
    n1, n0 = F.col("n_pos"), F.col("n_neg")
    pooled = F.sqrt(((n1 - 1) * F.col("_v1") + (n0 - 1) * F.col("_v0")) / (n1 + n0 - 2))
    d = F.when((n1 < 2) | (n0 < 2), None).when(pooled == 0, 0.0).otherwise(F.try_divide(F.col("mean_pos") - F.col("mean_neg"), pooled))
    return agg.withColumn("cohen_d", d).drop("_v1", "_v0")


def mann_whitney(frame: DataFrame, label: str, features: list[str]) -> DataFrame:
    """U of the positive class and its two-sided normal approximation with tie and continuity corrections."""
    rows = long_features(frame, label, features).where("v is not null")
    grouped = rows.groupBy("feature", "v").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    run = running(grouped, "v", {"below": "neg"}, by=("feature",))
    t = (F.col("pos") + F.col("neg")).cast("double")
    agg = run.groupBy("feature").agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.try_divide(F.abs(F.col("u") - n1 * n2 / 2) - 0.5, sd)
    return agg.select("feature", "u", "n1", "n2", normal_tails(z).alias("p"))


def normal_tails(z: Column) -> Column:
    """Two-sided tail of the normal law, by a published rational approximation of erfc (relative error under 1.2e-7)."""
    x = F.greatest(z, F.lit(0.0)) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the approximation, from the constant up.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = F.lit(0.0)
    for c in reversed(coefficients):
        power = power * t + c
    return F.least(F.lit(1.0), t * F.exp(-x * x + power))


def bh_adjust(frame: DataFrame, p: str = "p") -> DataFrame:
    """Benjamini-Hochberg p-values. ``frame`` has one row for each test (a list of features), so one window holds it."""
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(p, "feature"))
    staged = frame.withColumns({"_m": m, "_r": rank}).withColumn("_q", F.col(p) * F.col("_m") / F.col("_r"))
    low = F.min("_q").over(Window.partitionBy(F.lit(0)).orderBy("_r").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return staged.withColumn("p_bh", F.least(F.lit(1.0), low)).drop("_m", "_r", "_q")


def compare_features(frame: DataFrame, label: str, features: list[str], alpha: float = 0.05) -> DataFrame:
    """Of each feature: means, effect size, U, p, corrected p and whether it is significant."""
    tests = bh_adjust(mann_whitney(frame, label, features))
    return cohens_d(frame, label, features).join(tests.select("feature", "u", "p", "p_bh"), "feature").withColumn("significant", (F.col("p_bh") < alpha).cast("long"))


def mcnemar(frame: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Rows that only model a, or only model b, gets right; exact binomial p under 25 such rows, else chi square."""
    agg = frame.agg(
        F.sum(((F.col(a) == F.col(y)) & (F.col(b) != F.col(y))).cast("long")).alias("b"), F.sum(((F.col(a) != F.col(y)) & (F.col(b) == F.col(y))).cast("long")).alias("c"),
    )
    spark = frame.sparkSession
    row = agg.first()
    return spark.createDataFrame([(row["b"] or 0, row["c"] or 0, mcnemar_p(row["b"] or 0, row["c"] or 0))], "b long, c long, p double")


def mcnemar_p(b: int, c: int) -> float:
    n = b + c
    if not n:
        return 1.0
    if n < 25:
        return min(1.0, 2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)) / 2**n)
    return math.erfc(math.sqrt((abs(b - c) - 1) ** 2 / n / 2))


def delong_parts(frame: DataFrame, y: str, scores: tuple[str, str]) -> DataFrame:
    """AUROC of two scores over the same rows, with the variances and covariance of their structural components.

    Each row's component is the share of the other class below it (ties count half), from counts by distinct
    score; rows get it by a join on their score.
    """
    wide = frame
    for name in scores:
        per = wide.groupBy(F.col(name).cast("double").alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
        totals = per.agg(F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"))
        run = running(per, "score", {"below_neg": "neg", "below_pos": "pos"}).join(F.broadcast(totals))  # one row
        v10 = F.try_divide(F.col("below_neg") - F.col("neg") / 2, F.col("_n"))
        v01 = 1 - F.try_divide(F.col("below_pos") - F.col("pos") / 2, F.col("_p"))
        part = run.select(F.col("score").alias(f"_s_{name}"), v10.alias(f"_v10_{name}"), v01.alias(f"_v01_{name}"))
        wide = wide.join(part, F.col(name).cast("double") == F.col(f"_s_{name}"))
    a, b = scores
    of = lambda k, n: F.when(F.col(y) == k, F.col(f"_v{'10' if k else '01'}_{n}"))
    return wide.agg(
        F.avg(of(1, a)).alias("auc_a"), F.avg(of(1, b)).alias("auc_b"),
        (F.var_samp(of(1, a)) / F.count(of(1, a)) + F.var_samp(of(0, a)) / F.count(of(0, a))).alias("var_a"),
        (F.var_samp(of(1, b)) / F.count(of(1, b)) + F.var_samp(of(0, b)) / F.count(of(0, b))).alias("var_b"),
        (F.covar_samp(of(1, a), of(1, b)) / F.count(of(1, a)) + F.covar_samp(of(0, a), of(0, b)) / F.count(of(0, a))).alias("cov"),
    )


def delong_test(frame: DataFrame, y: str, scores: tuple[str, str]) -> dict[str, float]:
    r = delong_parts(frame, y, scores).first()
    spread = math.sqrt(max(r["var_a"] + r["var_b"] - 2 * r["cov"], 1e-18))
    z = (r["auc_a"] - r["auc_b"]) / spread
    return {"auc_a": r["auc_a"], "auc_b": r["auc_b"], "z": z, "p": math.erfc(abs(z) / math.sqrt(2))}


def poisson_bounds(most: int = 12) -> list[str]:
    """Ten hexadecimal digits that a draw must reach to count 1, 2, ... times."""
    total, term, out = 0.0, math.exp(-1), []
    for k in range(most):
        total += term
        term /= k + 1
        out.append(f"{min((1 << 40) - 1, round(total * (1 << 40))):010x}")
    return out


def poisson_weight(key: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) weight from an md5 of seed, row and draw, so that a resample does not depend on partitions."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), draw.cast("string"))), 1, 10)
    return F.size(F.filter(F.lit(poisson_bounds()), lambda bound: digits >= bound))


def resampled(frame: DataFrame, key: str, draws: int, seed: int = 42) -> DataFrame:
    """The rows of each Poisson resample, with its number as ``draw``; a row that is drawn twice stands there twice."""
    drawn = frame.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    weight = poisson_weight(F.col(key), F.col("draw"), seed)
    return drawn.withColumn("_w", weight).where("_w > 0").withColumn("_w", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")


#: Weights (rows times draws) that a task works out at once.
WEIGHTS = 1 << 21


def drawn_sums(frame: DataFrame, key: str, columns: list[str], draws: int, seed: int = 42, by: str | None = None) -> DataFrame:
    """(draw, by, n, columns): of each Poisson resample the sums of its weights and of weights times columns (whole numbers), by the
    distinct values of the double ``by`` if it is given (then without those that weigh nothing). Weights are those of ``poisson_weight``.

    A task sums its rows by draw before anything is shuffled, so a row is never laid down once for each draw.
    """
    chosen = frame.select(F.concat(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), F.lit("|")).alias("k"), *([F.col(by).cast("double").alias("by")] if by else []), *[F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(columns)])
    bounds = np.array([int(b, 16) for b in poisson_bounds()], np.uint64)
    width, rows_at_once = 1 + len(columns), max(1, WEIGHTS // draws)
    schema = "draw int, " + ("by double, " if by else "") + "n long" + "".join(f", c{i} long" for i in range(len(columns)))
    names = [part.split()[0] for part in schema.split(", ")]

    def laid(sums: dict[float | None, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Sums of one value of ``by``: weights, columns, and after them how many known numbers each column had."""
        for value, table in sums.items():
            drawn = np.flatnonzero(table[0]) if by else np.arange(draws)
            out = [pa.array(drawn + 1, pa.int32()), *([pa.array([value] * len(drawn), pa.float64())] if by else [])]
            out += [pa.array(table[0][drawn]), *[pa.array(table[i][drawn], pa.int64(), mask=table[width + i - 1][drawn] == 0) for i in range(1, width)]]
            yield pa.RecordBatch.from_arrays(out, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[float | None, np.ndarray] = {}
        numbers = np.arange(1, draws + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                keys = [k.encode() for k in part.column(0).to_pylist()]
                head = numbered_md5(keys, np.repeat(np.arange(len(keys)), draws), np.tile(numbers, len(keys)))
                ten = head[0].astype(np.uint64) << np.uint64(8) | (head[1] >> np.uint32(24)).astype(np.uint64)
                weight = np.searchsorted(bounds, ten, side="right").reshape(len(keys), draws)
                own = [part.column(i).to_pylist() for i in range(part.num_columns - len(columns), part.num_columns)]
                value = np.array([[0 if x is None else x for x in c] for c in own], np.int64).reshape(len(columns), len(keys))
                known = np.array([[x is not None for x in c] for c in own], np.int64).reshape(len(columns), len(keys))
                groups: dict[float | None, list[int]] = {}
                for i, v in enumerate(part.column(1).to_pylist() if by else [None] * len(keys)):
                    groups.setdefault(v, []).append(i)
                for v, rows in groups.items():
                    w = weight[rows]
                    more = np.concatenate([w.sum(axis=0)[None], value[:, rows] @ w, known[:, rows] @ w])
                    sums[v] = sums[v] + more if v in sums else more
                if len(sums) > 4096:
                    yield from laid(sums)
                    sums.clear()
        yield from laid(sums)

    parts = chosen.mapInArrow(work, schema)
    sure = parts.groupBy("draw", *(["by"] if by else [])).agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(c) for i, c in enumerate(columns)])
    return sure.withColumnRenamed("by", by) if by and by not in ("draw", "n") else sure


def bootstrap_f1(frame: DataFrame, key: str, y: str, pred: str, draws: int = 500, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of F1 by a Poisson bootstrap: each draw's counts are partial sums, nothing is collected."""
    hit = lambda a, b: F.when((F.col(y) == a) & (F.col(pred) == b), 1).otherwise(0)
    wide = frame.select(F.col(key).alias("k"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    sums = drawn_sums(wide, "k", ["tp", "fp", "fn"], draws, seed)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    own = frame.agg(F.expr(f"coalesce(try_divide(2D * sum(if({y} = 1 and {pred} = 1, 1, 0)), sum({y}) + sum({pred})), 0D)").alias("point")).first()["point"]
    return sums.select(f1.alias("f1")).agg(F.lit(own).alias("point"), F.expr(f"percentile(f1, {alpha / 2}D)").alias("lo"), F.expr(f"percentile(f1, {1 - alpha / 2}D)").alias("hi"))


def paired_bootstrap(frame: DataFrame, key: str, y: str, a: str, b: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Interval and two-sided p of the difference in accuracy of two models over the same resampled rows."""
    wide = frame.select(F.col(key).alias("k"), ((F.col(a) == F.col(y)).cast("int") - (F.col(b) == F.col(y)).cast("int")).alias("d"))
    each = drawn_sums(wide, "k", ["d"], draws, seed).select("draw", F.try_divide(F.col("d").cast("double"), F.col("n")).alias("delta"))
    share = F.least(F.avg((F.col("delta") <= 0).cast("double")), F.avg((F.col("delta") >= 0).cast("double")))
    return each.agg(F.avg("delta").alias("delta"), F.expr("percentile(delta, 0.025D)").alias("lo"), F.expr("percentile(delta, 0.975D)").alias("hi"), F.least(F.lit(1.0), 2 * share).alias("p"))


def fit_temperature(frame: DataFrame, y: str = "y", score: str = "score", low: float = 0.05, high: float = 20.0, rounds: int = 4, points: int = 24) -> float:
    """The temperature of least log loss. Each round is one pass that sums the loss on a grid of temperatures, then the grid narrows."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    base = frame.select(F.log(p / (1 - p)).alias("z"), F.col(y).cast("double").alias("y")).groupBy("z", "y").count()
    a, b = math.log(low), math.log(high)
    best = 1.0
    for _ in range(rounds):
        grid = [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]
        wide = base.select("z", "y", "count", F.explode(F.array(*map(F.lit, grid))).alias("t"))
        m = F.col("z") / F.col("t") * (1 - 2 * F.col("y"))
        loss = F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m)))
        rows = wide.groupBy("t").agg(F.sum(loss * F.col("count")).alias("l")).orderBy("l", "t").collect()
        best = rows[0]["t"]
        at = grid.index(min(grid, key=lambda g: abs(g - best)))
        a, b = math.log(grid[max(0, at - 1)]), math.log(grid[min(points - 1, at + 1)])
    return best


def apply_temperature(score: Column, t: float) -> Column:
    p = F.least(F.greatest(score, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-F.log(p / (1 - p)) / t))


def contribution_summary(frame: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Of (feature, contribution) columns: mean size, and the sign of their correlation ('0' without spread)."""
    rows = frame.selectExpr(f"stack({len(pairs)}, " + ", ".join(f"'{v}', cast(`{v}` as double), cast(`{c}` as double)" for v, c in pairs) + ") as (feature, v, c)")
    agg = rows.groupBy("feature").agg(F.avg(F.abs("c")).alias("mean_abs"), F.covar_pop("v", "c").alias("_r"), F.stddev_pop("v").alias("_sv"), F.stddev_pop("c").alias("_sc"))
    flat = (F.col("_sv") < 1e-12) | (F.col("_sc") < 1e-12)
    return agg.select("feature", "mean_abs", F.when(flat, "0").when(F.col("_r") >= 0, "+").otherwise("-").alias("sign"))
