"""How filters interact: survivors of every subset of filters, by a subset-zeta transform of mask counts."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SPACE = r"\x20\x09-\x0D"
LETTERS = "ABCDE"


def quality_filters(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter, by letter: A few words, B repetitive words, C many capitals, D markup signs. No null for a text that isn't null."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 65,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of a part that fail exactly the filters of ``mask`` (bit 0 is A, bit 4 E), and how many of them are labelled quality 1 or toxic 1.

    E is failed by a row whose text an even smaller id of the table has; texts are told apart by SHA-256. A null text is
    empty, a null part the empty string. A null id is neither smaller nor larger than another, so it does not fail E, and has no
    labels. Rows that repeat an id count each, and neither fails E for the other. Several labels of an id count as their greatest.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failing = quality_filters(text)
    bits = sum((F.when(failing[letter], 1 << bit).otherwise(0) for bit, letter in enumerate("ABCD")), F.lit(0))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = scratch.put(docs.select(F.col(id_col).alias("doc"), part.alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("key")))
    flag = lambda c: F.max((F.coalesce(c, F.lit(0)) == 1).cast("int"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("doc")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    one = ["part", "mask", "key", "good", "toxic"]
    # Rows that repeat become one with their number; ids are alike in their partitioning, so this takes the labels' shuffle.
    labelled = rows.where("doc IS NOT NULL").join(known.where("good + toxic > 0"), "doc", "left").fillna(0, ["good", "toxic"]).groupBy("doc", *one).agg(F.count("*").alias("c"))
    # Copies of a text combine before they are shuffled: a row for each part and label of a text, with the number of its first id's rows.
    kinds = labelled.groupBy(*one).agg(F.sum("c").alias("n"), F.min(F.struct("doc", "c")).alias("first"))
    kinds = scratch.put(kinds.select(*one, "n", F.col("first.doc").alias("doc"), F.col("first.c").alias("c")))
    least = kinds.groupBy("key").agg(F.min("doc").alias("least"))
    kept = F.when(F.col("doc") == F.col("least"), F.col("c")).otherwise(0)
    split = kinds.join(least, "key").select("part", "good", "toxic", F.explode(F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("s"))
    nameless = rows.where("doc IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select("part", "mask", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    counted = split.select("part", "s.mask", "s.n", "good", "toxic").where("n > 0").unionByName(nameless)
    return counted.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _pass(counts: str, bit: int) -> Column:
    return F.transform(counts, lambda x, i: x + F.when(i.bitwiseAND(bit) != 0, F.get(counts, i - bit)).otherwise(0))


def survivors(counts: DataFrame, filters: int = 5, measures: Sequence[str] = ("n", "good", "toxic")) -> DataFrame:
    """A row for each part, with an array for each measure whose element S (0 to 2^filters - 1) counts the rows that no filter of the subset S fails.

    The rows whose failed filters all lie outside S: a sum over subsets of S's complement, by the zeta
    transform, a pass for each filter in which each element takes over the one without that filter.
    """
    size = 1 << filters
    one = [F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).cast("long") for m in range(size)]).alias(c) for c in measures]
    out = counts.groupBy("part").agg(*one)
    for bit in range(filters):
        out = out.withColumns({c: _pass(c, 1 << bit) for c in measures})
    return out.withColumns({c: F.reverse(c) for c in measures})  # the complement of S is size - 1 - S


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, each order of the filters and each step of it, from ``mask_counts``.

    A step's kept and removed rows are survivors of neighbouring subsets and their difference; redundant ones fail its
    filter but went before; unique_fails fail no other filter; good_lost and toxic_lost are differences over labelled rows;
    shapley sums what the filter removes over all orders. Rows of zeros are kept. No counts, no rows.
    """
    n = len(letters)
    full = (1 << n) - 1
    steps = []
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'was', {before}, 'now', {before | 1 << i}, 'bit', {1 << i})")
            before |= 1 << i
    table = survivors(counts, n)
    fail = [F.get("n", F.lit(0)) - F.get("n", F.lit(1 << i)) for i in range(n)]
    only = [F.get("n", F.lit(full ^ 1 << i)) - F.get("n", F.lit(full)) for i in range(n)]
    # An order has S before filter i in |S|! (n - 1 - |S|)! ways.
    value = [
        sum((F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) * (F.get("n", F.lit(s)) - F.get("n", F.lit(s | 1 << i))) for s in range(full + 1) if not s >> i & 1), F.lit(0).cast("long"))
        for i in range(n)
    ]
    by_bit = lambda columns: F.map_from_arrays(F.array(*[F.lit(1 << i) for i in range(n)]), F.array(*columns))
    each = table.select("part", "n", "good", "toxic", by_bit(fail).alias("fail"), by_bit(only).alias("only"), by_bit(value).alias("value"), F.explode(F.expr(f"array({', '.join(steps)})")).alias("s"))
    removed = lambda c: F.get(c, F.col("s.was")) - F.get(c, F.col("s.now"))
    return each.select(
        "part", F.col("s.filter_order").alias("filter_order"), F.col("s.step").alias("step"),
        F.get("n", F.col("s.now")).alias("kept"), removed("n").alias("removed"), (F.element_at("fail", F.col("s.bit")) - removed("n")).alias("redundant"),
        F.element_at("only", F.col("s.bit")).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.element_at("value", F.col("s.bit")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit`` over all rows of ``docs``, counted once."""
    scratch = Scratch(docs.sparkSession, "filter_audit")
    return audit(scratch.put(mask_counts(docs, labels, scratch)))
