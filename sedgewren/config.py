"""Settings from YAML: communities with their priors, labelling weights, model options."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import labels
from .schemas import TARGETS


@dataclass(frozen=True)
class Community:
    name: str
    group: str = "baseline"
    priors: dict[str, float] = field(default_factory=dict)
    notes: str = ""


@dataclass(frozen=True)
class Labelling:
    prior_weight: float = 0.5
    lexicon_weight: float = 0.5
    thresholds: dict[str, float] = field(default_factory=lambda: dict(labels.THRESHOLDS))
    max_tokens: int = labels.MAX_TOKENS
    precedence: tuple[str, ...] = labels.PRECEDENCE
    confidence: dict[str, float] = field(default_factory=lambda: dict(labels.CONFIDENCE))


@dataclass(frozen=True)
class ModelSettings:
    name: str
    options: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)


def read_yaml(path: str | Path) -> dict[str, Any]:
    """A file's settings. What is no file of the driver is read through the active session, so it may be in any of Spark's stores."""
    import yaml

    if not Path(path).is_file() and SparkSession.getActiveSession() is not None:
        rows = SparkSession.getActiveSession().read.text(str(path), wholetext=True).collect()  # a settings file
        return yaml.safe_load("\n".join(r[0] for r in rows)) or {}
    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


def load_communities(path: str | Path) -> list[Community]:
    """Entries of a list under ``subreddits``; a target's prior is its expected_<target>_prior, else 0."""
    entries = read_yaml(path).get("subreddits", [])
    return [Community(e["name"], e.get("group", "baseline"), {t: float(e.get(f"expected_{t}_prior", 0.0)) for t in TARGETS}, e.get("notes", "")) for e in entries]


def load_labelling(path: str | Path) -> Labelling:
    data = read_yaml(path)
    weak, merged = data.get("tier1_weak", {}), data.get("aggregate", {})
    default = Labelling()
    return Labelling(
        weak.get("subreddit_prior_weight", default.prior_weight), weak.get("lexicon_weight", default.lexicon_weight), default.thresholds | weak.get("thresholds", {}), weak.get("max_tokens_for_lex", default.max_tokens),
        tuple(merged.get("precedence", default.precedence)), default.confidence | merged.get("tier_confidence", {}),
    )


def load_model(path: str | Path) -> ModelSettings:
    """``name`` and ``options``; keys that are not known are kept in ``extra``."""
    data = read_yaml(path)
    known = {"name", "options"}
    return ModelSettings(data.get("name", "tfidf"), data.get("options", {}), {k: v for k, v in data.items() if k not in known})


def priors_frame(spark: SparkSession, communities: list[Community]) -> DataFrame:
    """The communities as a small table for the prior and group joins."""
    rows = [(c.name, c.group, *[c.priors.get(t, 0.0) for t in TARGETS]) for c in communities]
    return spark.createDataFrame(rows, "name string, `group` string, " + ", ".join(f"prior_{t} double" for t in TARGETS))
