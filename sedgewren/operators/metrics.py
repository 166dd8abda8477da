"""Metrics of binary scores as set-based queries: curves, thresholds, calibration, subgroups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by_score, exact_quantiles, running


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def counts(y: Column, pred: Column) -> dict[str, Column]:
    both = lambda a, b: F.sum(F.when((y == a) & (pred == b), 1).otherwise(0))
    return {"tp": both(1, 1), "fp": both(0, 1), "fn": both(1, 0), "tn": both(0, 0)}


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def basic_metrics(frame: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined), Brier score and supports, in one pass."""
    pred = (F.col(score) >= threshold).cast("int")
    c = counts(F.col(y), pred)
    agg = frame.groupBy(*by).agg(*[v.alias(k) for k, v in c.items()], F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return agg.select(
        *by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"), "brier", (tp + fn).alias("support_pos"), (fp + tn).alias("support_neg"),
    )


def auroc(frame: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve by midranks of distinct scores; null with one class."""
    run = running(by_score(frame, F.col(y), F.col(score), by), "score", {"below": "neg"}, by=by)
    agg = run.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return agg.select(*by, ratio(F.col("_u"), F.col("_p") * F.col("_n"), None).alias("auroc"))


def curve(frame: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Of each distinct score as a threshold: tp, fp, and all positives. All of it comes from one table of counts."""
    counted = by_score(frame, F.col(y), F.col(score), by)
    run = running(counted, "score", {"tp": "pos", "fp": "neg"}, descending=True, by=by)
    totals = counted.groupBy(*by).agg(F.sum("pos").alias("all_pos"))
    return run.join(totals, list(by)) if by else run.join(F.broadcast(totals))  # one row without groups


def auprc(frame: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision: the sum of precision times the step in recall."""
    c = curve(frame, y, score, by)
    return c.groupBy(*by).agg(F.sum(ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("auprc"))


def best_threshold(frame: DataFrame, y: str = "y", score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """The threshold of greatest F1, the lowest of equal ones."""
    c = curve(frame, y, score, by)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("all_pos"))
    f1 = 2 * precision * recall / (precision + recall + 1e-12)
    # F1 is compared at twelve digits, so that sums in another order don't change which of equal ones wins.
    best = F.max_by(F.struct(F.col("score").alias("threshold"), f1.alias("f1")), F.struct(F.round(f1, 12), -F.col("score")))
    return c.groupBy(*by).agg(best.alias("b")).select(*by, "b.threshold", "b.f1")


def calibration(frame: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    """(bin, n, observed, predicted) of equal-width bins, right-open, with 1 in the last."""
    bin_of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return frame.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("observed"), F.avg(score).alias("predicted"))


def calibration_error(frame: DataFrame, y: str = "y", score: str = "score", bins: int = 10) -> DataFrame:
    c = calibration(frame, y, score, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece"))


def add_predictions(frame: DataFrame, y: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    pred = (F.col(score) >= threshold).cast("long")
    name = F.when(pred == 1, F.when(F.col(y) == 1, "TP").otherwise("FP")).otherwise(F.when(F.col(y) == 1, "FN").otherwise("TN"))
    return frame.withColumns({"pred": pred, "err": (pred != F.col(y)).cast("long"), "bucket": name})


def confusion_by(frame: DataFrame, group: str, y: str = "y", pred: str = "pred") -> DataFrame:
    c = counts(F.col(y), F.col(pred))
    agg = frame.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"), *[v.alias(k) for k, v in c.items()])
    tp, fp, fn = (F.col(k) for k in ("tp", "fp", "fn"))
    return agg.select(group, "n", "n_pos", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1_of(tp, fp, fn).alias("f1"))


def subgroup_metrics(frame: DataFrame, group: str, y: str = "y", pred: str = "pred", min_n: int = 30, min_pos: int = 5) -> DataFrame:
    """TPR, FPR, F1 and selection rate of groups with enough rows; the null group is left out."""
    c = counts(F.col(y), F.col(pred))
    agg = frame.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("long")).alias("n_pos"), *[v.alias(k) for k, v in c.items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    kept = agg.where((F.col("n") >= min_n) & (F.col("n_pos") >= min_pos))
    return kept.select(group, "n", "n_pos", ratio(tp, tp + fn, None).alias("tpr"), ratio(fp, fp + tn, None).alias("fpr"), f1_of(tp, fp, fn).alias("f1"), ratio(tp + fp, F.col("n")).alias("selection_rate"))


def fairness_gaps(groups: DataFrame) -> DataFrame:
    """Greatest minus least of each rate over the groups; null with fewer than two."""
    gap = lambda c: F.when(F.count("*") >= 2, F.max(c) - F.min(c))
    agg = groups.agg(gap("tpr").alias("tpr_gap"), gap("fpr").alias("fpr_gap"), gap("selection_rate").alias("selection_rate_gap"))
    return agg.withColumn("equalized_odds_diff", F.greatest("tpr_gap", "fpr_gap"))


def quantile_bins(frame: DataFrame, column: str, q: int = 5) -> DataFrame:
    """Adds bin: equal-frequency bins by exact quantiles, right-closed, the least included, equal edges merged."""
    edges = exact_quantiles(frame, column, [i / q for i in range(1, q)]).first()
    cuts = sorted({v for v in edges if v is not None})
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col(column) <= cuts[i], i).otherwise(out)
    return frame.withColumn("bin", out.cast("long"))


def length_effect(frame: DataFrame, length: str, q: int = 5, y: str = "y", pred: str = "pred") -> DataFrame:
    c = counts(F.col(y), F.col(pred))
    agg = quantile_bins(frame, length, q).groupBy("bin").agg(F.count("*").alias("n"), F.avg(length).alias("mean_length"), *[v.alias(k) for k, v in c.items()])
    return agg.select("bin", "n", "mean_length", f1_of(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"))


def group_thresholds(frame: DataFrame, group: str, y: str = "y", score: str = "score", least: int = 25) -> DataFrame:
    """Each group's own best threshold where it has enough of both classes, else the one of all."""
    whole = best_threshold(frame, y, score).first()
    sizes = frame.groupBy(group).agg(F.sum(F.col(y).cast("long")).alias("p"), F.sum(1 - F.col(y).cast("long")).alias("n"))
    own = best_threshold(frame, y, score, (group,)).select(group, F.col("threshold").alias("own"))
    enough = (F.col("p") >= least) & (F.col("n") >= least)
    return sizes.join(own, group).select(group, F.when(enough, F.col("own")).otherwise(F.lit(whole["threshold"])).alias("threshold"), enough.cast("long").alias("tuned"))


def apply_thresholds(frame: DataFrame, thresholds: DataFrame, group: str, default: float = 0.5, score: str = "score") -> DataFrame:
    """pred by each group's threshold; groups without one take ``default``."""
    joined = frame.join(thresholds.select(group, F.col("threshold").alias("_t")), group, "left")
    return joined.withColumn("pred", (F.col(score) >= F.coalesce("_t", F.lit(default))).cast("long")).drop("_t")


def macro_f1(frame: DataFrame, group: str, y: str = "y", pred: str = "pred", min_pos: int = 5) -> DataFrame:
    return confusion_by(frame, group, y, pred).where(F.col("n_pos") >= min_pos).agg(F.avg("f1").alias("macro_f1"), F.count("*").alias("n_groups"))


def flip_rate(frame: DataFrame, a: str, b: str, score_a: str, score_b: str, by: tuple[str, ...] = ()) -> DataFrame:
    return frame.groupBy(*by).agg(F.avg((F.col(a) != F.col(b)).cast("double")).alias("flip_rate"), F.avg(F.abs(F.col(score_a) - F.col(score_b))).alias("mean_abs_drift"))


def class_f1(frame: DataFrame, y: str, pred: str) -> DataFrame:
    """Weighted and macro F1 over the classes of either column, by per-class sums."""
    sides = frame.select(F.explode(F.array_distinct(F.array(F.col(y), F.col(pred)))).alias("c"), F.col(y).alias("y"), F.col(pred).alias("p"))
    per = sides.groupBy("c").agg(
        F.sum(((F.col("y") == F.col("c")) & (F.col("p") == F.col("c"))).cast("long")).alias("tp"), F.sum((F.col("y") == F.col("c")).cast("long")).alias("support"), F.sum((F.col("p") == F.col("c")).cast("long")).alias("called"),
    ).withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("called")))
    return per.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("f1").alias("macro_f1"))


def weighted_kappa(frame: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Quadratic weighted kappa, mean absolute error, and the share more than one level off, from the level counts."""
    cells = frame.groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    # At most levels squared rows: the expected counts come from the margins of this small table.
    d = F.pow((F.col("i") - F.col("j")).cast("double"), 2)
    rows = cells.groupBy("i").agg(F.sum("n").alias("ni"))
    columns = cells.groupBy("j").agg(F.sum("n").alias("nj"))
    expected = rows.join(columns, F.lit(True)).agg(F.sum(d * F.col("ni") * F.col("nj")).alias("e"))
    seen = cells.agg(F.sum(d * F.col("n")).alias("o"), F.sum("n").alias("t"), F.sum(F.abs(F.col("i") - F.col("j")) * F.col("n")).alias("s"), F.sum(F.when(F.abs(F.col("i") - F.col("j")) > 1, F.col("n")).otherwise(0)).alias("far"))
    return seen.join(expected, F.lit(True)).select((1 - F.try_divide(F.col("o") * F.col("t"), F.col("e"))).alias("qwk"), (F.col("s") / F.col("t")).alias("mae"), (F.col("far") / F.col("t")).alias("far_share"))


def cohen_kappa(frame: DataFrame, a: str, b: str, least: int = 5) -> DataFrame:
    """Cohen's kappa of two 0/1 columns; null under ``least`` rows."""
    x, z = F.col(a).cast("double"), F.col(b).cast("double")
    agg = frame.agg(F.count("*").alias("n"), F.avg((x == z).cast("double")).alias("po"), F.avg(x).alias("pa"), F.avg(z).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return agg.select("n", F.when(F.col("n") >= least, F.coalesce(F.try_divide(F.col("po") - pe, 1 - pe), F.lit(1.0))).alias("kappa"))


def confusion_matrix(frame: DataFrame, y: str, pred: str) -> DataFrame:
    """(y, pred, n, share of the row)."""
    cells = frame.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return cells.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))
