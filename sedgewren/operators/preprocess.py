"""From raw posts to interim ones: clean, filter, redact, pseudonymise, remove duplicates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import approx
from ..functions import text as T
from ..session import settled
from . import names
from .dedup import dedup_both, exact_dedup

GONE = ("[deleted]", "[removed]", "")


def passes_filters(least_score: int = 0, least_chars: int = 0) -> Column:
    """Submissions must be texts; score and length have floors."""
    own_text = (F.coalesce("kind", F.lit("submission")) != "submission") | F.coalesce("is_self", F.lit(False))
    return own_text & (F.col("score") >= least_score) & (F.length(F.coalesce("body", F.lit(""))) >= least_chars)


def present(body: Column) -> Column:
    """A body that was not deleted; a null one counts as present, since the title may carry the text."""
    return F.coalesce(~F.lower(T.strip(body)).isin(*GONE), F.lit(True))


def known_author(author: Column) -> Column:
    return author.isNotNull() & ~F.lower(author).isin("[deleted]", "[removed]", "automoderator", "")


def preprocess(posts: DataFrame, least_chars: int = 50, language: str | None = "en", near: int = -1, detector: Callable[[Column], Column] | None = None, tagger: names.Tagger | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Adds clean_text, lang and author_hash, drops author. Cheap filters come before Python and shuffles; ``near`` is the Hamming distance of near-dedup (-1: exact only).

    ``detector`` is a function from a text to its language (``language.language_by_profile`` with fitted profiles, say); without it
    frequent words decide. ``tagger`` finds names, which become their kind. ``columns`` of the posts stay (without it all), beside
    id and subreddit; name few, since kept rows are written once before duplicates are looked for.
    """
    if columns is not None:
        posts = posts.select(*dict.fromkeys(["id", "subreddit", "title", "body", "author", *columns]))
    kept = T.once(posts.where(present(F.col("body"))), clean_text=T.clean_text(F.col("title"), F.col("body"))).where(F.length("clean_text") >= least_chars)
    if detector is None:
        kept = T.once(T.once(kept, _words=T.tokens(F.col("clean_text"))), lang=approx.language_of(F.col("_words"))).drop("_words")
    else:
        kept = T.once(kept, lang=detector(F.col("clean_text")))
    if language:
        kept = kept.where(F.col("lang") == language)
    kept = T.once(kept, clean_text=T.redact(F.col("clean_text")), author_hash=T.pseudonym(F.col("author"))).drop("author")
    if tagger is not None:
        kept = T.once(kept, clean_text=names.redact_names(F.col("clean_text"), tagger))
    if columns is not None:
        kept = kept.select(*dict.fromkeys(["id", "subreddit", *(c for c in columns if c != "author")]), "clean_text", "lang", "author_hash")
    return exact_dedup(settled(kept), "clean_text", "id") if near < 0 else dedup_both(kept, "id", "subreddit", "clean_text", near)
