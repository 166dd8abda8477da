"""The stages' schemas, and a guard for columns that an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TARGETS = ("anxiety", "health_anxiety", "depression", "suicidality")

KINDS = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def struct(ddl: str) -> T.StructType:
    """A StructType of "name kind, ..."; unlike fromDDL it needs no session."""
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


POST_RAW = struct(
    "id string, subreddit string, created_utc double, title string, body string, author string, score long, num_comments long, "
    "permalink string, is_self boolean, over_18 boolean, source string, collected_at double, kind string, parent_id string"
)
POST_CLEAN = T.StructType([f for f in POST_RAW.fields if f.name != "author"] + struct("clean_text string, lang string, author_hash string").fields)
USERS = struct("author_hash string, " + ", ".join(f"user_{t} long" for t in TARGETS) + ", user_group string, n_posts long, subreddits string")
DECISION = struct("user_id string, true_label long, predicted_label long, posts_seen long, n_posts_total long")


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns {', '.join(missing)}; there are {', '.join(frame.columns)}")
    return frame
