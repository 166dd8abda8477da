"""Weak labels, label precedence, agreement, and the unsupervised label model."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lexicons import Lexicons
from ..schemas import TARGETS
from ..session import small

# Weights and thresholds of weak labels, precedence and confidence of label sources.
WEIGHTS = {"prior": 0.5, "lexicon": 0.5}
THRESHOLDS = {"anxiety": 0.55, "health_anxiety": 0.60, "depression": 0.55, "suicidality": 0.65}
PRECEDENCE = ("manual", "llm", "disclosure", "weak")
CONFIDENCE = {"manual": 1.0, "disclosure": 0.85, "llm": 0.7, "weak": 0.4}
MAX_TOKENS = 800


def community_priors(frame: DataFrame, priors: DataFrame, community: str, targets: tuple[str, ...] = TARGETS) -> DataFrame:
    """Adds prior_<target> by the community's name in lower case; 0 where it is not listed. Of names that differ in case alone one counts."""
    listed = priors.select(F.lower("name").alias("_name"), *[F.col(f"prior_{t}").cast("double").alias(f"prior_{t}") for t in targets]).dropDuplicates(["_name"])
    joined = frame.join(small(listed), F.lower(F.col(community)) == F.col("_name"), "left").drop("_name")
    return joined.fillna(0.0, [f"prior_{t}" for t in targets])


def weak_labels(frame: DataFrame, priors: DataFrame, text: str, community: str, lex: Lexicons | None = None, thresholds: dict[str, float] | None = None, max_tokens: int | None = None) -> DataFrame:
    """Adds weak_<target> (prior and lexicon score in equal parts) and weak_<target>_bin, over whole texts or their first ``max_tokens`` words."""
    thresholds = thresholds or THRESHOLDS
    wide = community_priors(frame, priors, community).withColumn("_words", T.tokens(F.col(text), max_tokens))
    scores = T.lexicon_scores(F.col(text), F.col("_words"), lex or Lexicons())
    wide = wide.withColumns({f"weak_{t}": WEIGHTS["prior"] * F.col(f"prior_{t}") + WEIGHTS["lexicon"] * s for t, s in scores.items()})
    return wide.withColumns({f"weak_{t}_bin": (F.round(f"weak_{t}", 12) >= thresholds[t]).cast("long") for t in scores}).drop("_words", *[f"prior_{t}" for t in TARGETS])


def aggregate_labels(frame: DataFrame, target: str, precedence: tuple[str, ...] = PRECEDENCE, confidence: dict[str, float] | None = None) -> DataFrame:
    """Adds label, label_source and label_weight from the columns <source>_<target> by precedence.

    A disclosure counts only where it is 1; its absence says nothing. Rows without any label are dropped.
    """
    confidence = confidence or CONFIDENCE
    label = source = weight = None
    for tier in precedence:
        name = f"{tier}_{target}"
        if name not in frame.columns:
            continue
        value = F.when(F.col(name) == 1, 1.0) if tier == "disclosure" else F.col(name).cast("double")
        held = value.isNotNull()
        label = F.when(held, value) if label is None else label.when(held, value)
        source = F.when(held, tier) if source is None else source.when(held, tier)
        weight = F.when(held, confidence.get(tier, 0.5)) if weight is None else weight.when(held, confidence.get(tier, 0.5))
    if label is None:
        raise ValueError(f"no label source for {target}")
    return frame.withColumns({f"label_{target}": label, f"label_{target}_source": source, f"label_{target}_weight": weight}).where(F.col(f"label_{target}").isNotNull())


def label_issues(frame: DataFrame, y: str, score: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Adds issue: a positive that scores at most ``low`` (1), a negative at least ``high`` (2), else 0."""
    return frame.withColumn("issue", F.when((F.col(y) == 1) & (F.col(score) <= low), 1).when((F.col(y) == 0) & (F.col(score) >= high), 2).otherwise(0).cast("long"))


def majority(votes: list[str]) -> F.Column:
    """Mean of the votes that don't abstain, a half if all do."""
    cast = F.filter(F.array(*[F.col(v).cast("double") for v in votes]), lambda v: v >= 0)
    total = F.aggregate(cast, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(cast) > 0, total / F.size(cast)).otherwise(0.5)


def dawid_skene(frame: DataFrame, votes: list[str], rounds: int = 100) -> tuple[DataFrame, dict]:
    """Posterior of each row by binary Dawid-Skene. Expectation-maximisation runs over the counts of vote patterns: at most three to the number of voters, whatever the rows."""
    if len(votes) > 10:
        raise ValueError("too many voters for a table of vote patterns")
    patterns = [(tuple(r[v] for v in votes), r["count"]) for r in frame.groupBy(*votes).count().orderBy(*votes).collect()]
    pi, sens, spec = 0.5, [0.7] * len(votes), [0.7] * len(votes)
    posterior = [0.5] * len(patterns)
    cut = lambda x: min(max(x, 1e-3), 1 - 1e-3)
    for _ in range(rounds if patterns else 0):
        for i, (pattern, _) in enumerate(patterns):
            one, zero = math.log(cut(pi) if pi in (0, 1) else pi), math.log(cut(1 - pi) if pi in (0, 1) else 1 - pi)
            for k, v in enumerate(pattern):
                if v == 1:
                    one, zero = one + math.log(cut(sens[k])), zero + math.log(1 - cut(spec[k]))
                elif v == 0:
                    one, zero = one + math.log(1 - cut(sens[k])), zero + math.log(cut(spec[k]))
            posterior[i] = 1 / (1 + math.exp(min(700.0, zero - one)))
        total = sum(n for _, n in patterns)
        pi = sum(r * n for r, (_, n) in zip(posterior, patterns, strict=True)) / total
        for k in range(len(votes)):
            rows = [(r, p[k], n) for r, (p, n) in zip(posterior, patterns, strict=True) if p[k] in (0, 1)]
            sens[k] = sum(r * n for r, v, n in rows if v == 1) / max(1e-9, sum(r * n for r, _, n in rows))
            spec[k] = sum((1 - r) * n for r, v, n in rows if v == 0) / max(1e-9, sum((1 - r) * n for r, _, n in rows))
    table = frame.sparkSession.createDataFrame([(*p, float(r)) for (p, _), r in zip(patterns, posterior, strict=True)], frame.select(*votes).schema.add("posterior", "double"))
    on = [frame[v].eqNullSafe(table[v]) for v in votes]
    joined = frame.join(F.broadcast(table), on).select(frame["*"], table["posterior"])  # at most 3 ** voters rows
    return joined, {"prior": pi, "sensitivity": sens, "specificity": spec}
