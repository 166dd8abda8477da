"""Self-reported diagnoses: patterns per condition, and what in the words before rules a match out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, in the order in which they are tried.
POSITIVE = {
    "anxiety": (
        r"\b(i|i've|i have|i am|i was|i got|i'm) (?:been )?diagnosed (?:with|as) (?:having |an? )?(?:generali[sz]ed |severe |chronic |clinical )?anxiety(?: disorder)?\b",
        r"\bmy (?:doctor|therapist|psychiatrist|psychologist|gp|md|shrink) (?:diagnosed me with|said i have|told me i (?:had|have)) (?:an? )?(?:generali[sz]ed )?anxiety(?: disorder)?\b",
        r"\bi (?:have|was diagnosed with|got diagnosed with) GAD\b",
        r"\bi (?:have|suffer from) generali[sz]ed anxiety disorder\b",
        r"\bi have panic disorder\b",
        r"\bi (?:have|suffer from|struggle with|am dealing with) (?:an? )?anxiety disorder\b",
        r"\bi'm on (?:medication|meds) for (?:my )?anxiety\b",
    ),
    "health_anxiety": (
        r"\b(i|i've|i have|i am|i was|i got|i'm) (?:been )?diagnosed (?:with|as) (?:having )?(?:health anxiety|illness anxiety|hypochondria(?:sis)?)\b",
        r"\bi (?:have|suffer from|struggle with|am dealing with) health anxiety\b",
        r"\bi (?:have|suffer from|struggle with) illness anxiety(?: disorder)?\b",
        r"\bi have IAD\b",
        r"\bi(?:'m| am) (?:a )?hypochondriac\b",
        r"\bi have hypochondria(?:sis)?\b",
        r"\bmy (?:doctor|therapist|psychiatrist|psychologist) (?:diagnosed me with|told me i have) (?:health anxiety|illness anxiety|hypochondria(?:sis)?)\b",
    ),
    "depression": (
        r"\b(i|i've|i have|i am|i was|i got|i'm) (?:been )?diagnosed (?:with|as) (?:having |an? )?(?:clinical |major |severe |chronic )?depress(?:ion|ive disorder)\b",
        r"\bmy (?:doctor|therapist|psychiatrist|psychologist|gp|md|shrink) (?:diagnosed me with|said i have|told me i (?:had|have)) (?:clinical |major |severe )?depress(?:ion|ive disorder)\b",
        r"\bi (?:have|was diagnosed with|got diagnosed with) MDD\b",
        r"\bi (?:have|suffer from) major depressive disorder\b",
        r"\bi (?:have|suffer from|struggle with|am dealing with) (?:clinical |major |severe )?depression\b",
        r"\bi(?:'m| am) (?:clinically |severely |majorly )?depressed\b",
        r"\bi'm on (?:antidepressants|medication|meds) for (?:my )?depression\b",
    ),
    "suicidality": (),
}
FILTERS = {
    "negation": (
        r"\b(?:not|never|no|n't|nor)\b", r"\bundiagnosed\b", r"\bcan't be\b", r"\bnever been\b", r"\bdidn't get\b", r"\bwon't be\b", r"\bwithout (?:being )?diagnosed\b",
    ),
    "hypothetical": (
        r"\bif (?:i|you|she|he|they) (?:were|was|am|get|got|could|might|had|have)\b", r"\bmight (?:have|be|need)\b", r"\bcould (?:have|be|get)\b", r"\bmaybe (?:i|you)\b", r"\bperhaps (?:i|you)\b",
        r"\bi think i (?:have|might|am|may)\b", r"\bi suspect (?:i|you)\b", r"\bi (?:fear|worry) (?:that )?i (?:have|might|may)\b", r"\bi wonder if (?:i|you)\b", r"\bwhat if (?:i|you|she|he)\b",
        r"\bdo i have\b", r"\bam i (?:depressed|anxious|going)\b", r"\bwould (?:probably )?be\b", r"\bseems like i (?:have|might)\b",
    ),
    "third_party": (
        r"\bmy (?:husband|wife|partner|boyfriend|girlfriend|spouse|fiancee?|son|daughter|kid|kids|child|children|mom|mum|mother|dad|father|sister|brother|sibling|friend|colleague|coworker|parent|parents|family member|aunt|uncle|cousin|grandma|grandpa|grandmother|grandfather|roommate|neighbor|ex)\b",
        r"\b(?:she|he|they) (?:was|has been|is|got) diagnosed\b", r"\b(?:someone i know|a friend|a relative) (?:has|with|suffers)\b",
    ),
    "denial": (
        r"\bdoctors? said i don't have\b", r"\bturns out i don't have\b", r"\bdoesn't actually have\b", r"\bnot a real diagnosis\b", r"\bjust kidding\b", r"\blol\b.{0,30}\b(?:depressed|anxious)\b",
    ),
}
BEFORE = 50  # characters before a match in which a filter rules it out; the match itself counts too

_POSITIVE = {t: [re.compile(p, re.IGNORECASE) for p in ps] for t, ps in POSITIVE.items()}
_FILTERS = [(name, re.compile("|".join(f"(?:{p})" for p in ps), re.IGNORECASE)) for name, ps in FILTERS.items()]


def detect(text: str | None, target: str) -> tuple[bool, str | None, str | None]:
    """(found, matched span, last filter): patterns go in order; the first match that no filter rules out wins."""
    last = None
    for pattern in _POSITIVE.get(target, ()) if text else ():
        for match in pattern.finditer(text):
            window = text[max(0, match.start() - BEFORE) : match.end()]
            ruled = next((name for name, known in _FILTERS if known.search(window)), None)
            if ruled is None:
                return True, match.group(0), None
            last = ruled
    return False, None, last


def prefilter(targets: tuple[str, ...]) -> str:
    """A pattern that every row with a match of any target has; it runs in the JVM before any Python."""
    return "(?i)" + "|".join(f"(?:{p})" for t in targets for p in POSITIVE[t])


# Every pattern names one of these; looking for literals is far cheaper than trying all patterns at each place.
NAMED = ("anxiety", "gad", "panic disorder", "iad", "hypochondria", "depress", "mdd")


def disclosure_labels(frame: DataFrame, text: str, targets: tuple[str, ...] = tuple(POSITIVE)) -> DataFrame:
    """Adds disclosure_<target> (0/1) and disclosure_<target>_match; Python sees the few rows with a candidate match alone."""
    schema = ", ".join(f"{t}: struct<hit: long, span: string, ruled: string>" for t in targets)

    @F.pandas_udf(f"struct<{schema}>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {t: [detect(v, t) if v is not None else (False, None, None) for v in batch] for t in targets}
            yield pd.DataFrame({t: [{"hit": int(h), "span": s, "ruled": r} for h, s, r in rows] for t, rows in found.items()})

    pattern = prefilter(targets)
    lower = F.lower(F.col(text))
    named = F.lit(False)
    for word in NAMED:
        named = named | lower.contains(word)
    candidate = F.when(F.when(named, F.col(text).rlike(pattern)), F.col(text))
    wide = frame.withColumn("_d", find(candidate))
    out = {}
    for t in targets:
        out[f"disclosure_{t}"], out[f"disclosure_{t}_match"] = F.col(f"_d.{t}.hit"), F.col(f"_d.{t}.span")
    return wide.withColumns(out).drop("_d")
