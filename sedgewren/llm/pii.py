"""Personal data: fixed patterns, and bootstrapped extraction by the labels and words that stand around identifiers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

KINDS = ("email", "ip", "card", "phone")
#: Seeds of a further kind: long random strings of hexadecimal digits.
SECRET = "secret"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is tried at its start alone: what fails there fails at every later digit of the run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A label (a whole word, but for digits that it begins with), a separator, perhaps a quotation mark, and a value, which
#: ends at white space and at signs between parameters. What is within a value is part of it; an address's ``//`` is none.
LABELLED = re.compile(r"(?<!\w)[0-9]*+([^\W\d]\w++)[\x20\t]?([=:#])[\x20\t]?([\"']?)(?!//)([^\s\"'<>|&?;,]{4,}+)")
HEX = re.compile(r"[0-9a-f]{32,}|[0-9A-F]{32,}")
SCAN = "doc_id long, doc_key long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<struct<pattern:string,value:long,kind:string,identifier:boolean,start:long,end:long>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the pattern for e-mail, found from their @ so that long words cost no more than once."""
    out, done = [], 0
    for match in DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at:
            out.append((start, match.end()))
            done = match.end()
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    for match in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.group().split(".")):
            out.append(("ip", *match.span()))
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = match.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in match.group()) <= 15:
                out.append(("phone", *match.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def named(word: str) -> str:
    """A word as a part of a pattern, whatever its case; one of over 64 characters by a digest of 128 bits, so that it is not copied with each place next to it."""
    folded = word.casefold()
    return folded if len(folded) <= 64 else xxhash.xxh3_128_hexdigest(folded.encode("utf-8", "surrogatepass"))


def labelled(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, str | None, bool, int, int]]:
    """(pattern, value's hash, seed kind or null, looks like an identifier, start, end) of each labelled value."""
    if "=" not in text and ":" not in text and "#" not in text:
        return []
    starts = {a: (k, b) for k, a, b in base}
    out = []
    for match in LABELLED.finditer(text):
        label, mark, quote, value = match.groups()
        start = match.start(4)
        value = value.rstrip(".,;:!?)")
        end = start + len(value)
        if start in starts:
            kind, end = starts[start]
            value = text[start:end]
        else:
            kind = SECRET if HEX.fullmatch(value) and re.search("[a-fA-F]", value) and re.search("[0-9]", value) else None
        # The lexical pattern: the label, whatever its case, its separator and the quotation mark.
        out.append((f"{named(label)} {mark} {quote}", xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass")) - (1 << 63), kind, len(value) >= 6 and any(c.isdigit() for c in value), start, end))
    return out


#: Characters that end a token, besides white space, and words or signs next to one.
TOKEN_ENDS = frozenset("\"'<>|=:#,;()[]{}")
DIGITS = re.compile(r"[0-9]+")
NEXT_TO = re.compile(r"[^\W\d_]+|[^\w\s]")


def around(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, str | None, bool, int, int]]:
    """As ``labelled``: each entity of the base patterns, and each other token that could be an identifier (six or more
    characters, a digit), with the word contexts it induces: the two words before it, and one on either side. Signs
    count as words, but a context holds a word of letters."""
    taken = sorted((a, b, k) for k, a, b in base)
    spots: list[tuple[int, int, str | None]] = [(a, b, k) for a, b, k in taken]
    done, at = 0, 0
    for match in DIGITS.finditer(text):
        start, end = match.span()
        if start < done:
            continue
        while start > done and not (text[start - 1].isspace() or text[start - 1] in TOKEN_ENDS):
            start -= 1
        while end < len(text) and not (text[end].isspace() or text[end] in TOKEN_ENDS):
            end += 1
        done = end
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        end -= len(text[start:end]) - len(text[start:end].rstrip(".,;:!?)"))
        if end - start < 6 or at < len(taken) and taken[at][0] < end:
            continue
        value = text[start:end]
        spots.append((start, end, SECRET if HEX.fullmatch(value) and re.search("[a-fA-F]", value) else None))
    afters = words_after(text, [end for _, end, _ in spots])
    out = []
    for (start, end, kind), before, after in zip(spots, words_before(text, [start for start, _, _ in spots]), afters, strict=True):
        value = xxhash.xxh64_intdigest(text[start:end].encode("utf-8", "surrogatepass")) - (1 << 63)
        if len(before) == 2 and any(letters for _, letters in before):
            out.append((f"{before[0][0]} {before[1][0]} _", value, kind, True, start, end))
        if before and after and (before[-1][1] or after[1]):
            out.append((f"{before[-1][0]} _ {after[0]}", value, kind, True, start, end))
    return out


def words_before(text: str, places: list[int]) -> list[list[tuple[str, bool]]]:
    """The last two words or signs that end at or before each place, and whether they are letters. From place to place the text is gone through once."""
    found: dict[int, list[tuple[str, bool]]] = {}
    held: list[tuple[int, int, str, bool]] = []  # start, end, name, letters
    done = 0
    for place in sorted(set(places)):
        if held and held[-1][1] == done:  # it may go on
            done = held.pop()[0]
        for match in NEXT_TO.finditer(text, done, place):
            held = [*held[-2:], (*match.span(), named(match.group()), match.group().isalpha())]
        done = place
        found[place] = [(name, letters) for *_, name, letters in held[-2:]]
    return [found[place] for place in places]


def words_after(text: str, places: list[int]) -> list[tuple[str, bool] | None]:
    """The first word or sign that begins at or after each place; none where the text has no more."""
    found: dict[int, tuple[str, bool] | None] = {}
    later, limit = None, len(text)
    for place in sorted(set(places), reverse=True):
        if match := NEXT_TO.search(text, place, limit):
            whole = NEXT_TO.match(text, match.start()).group()
            later = (named(whole), whole.isalpha())
        found[place], limit = later, place
    return [found[place] for place in places]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over whole texts: base spans, and the labelled values and word contexts around which patterns are learned.

    doc_key is xxhash64 of the text, by which rows of one id, and rows without an id, are told apart.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([("pattern", pa.string()), ("value", pa.int64()), ("kind", pa.string()), ("identifier", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())])
        names = ["doc_id", "doc_key", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]
        for batch in batches:
            rows = []
            for key, text, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                spans = base_spans(text)
                counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                found = [dict(zip(("pattern", "value", "kind", "identifier", "start", "end"), x, strict=True)) for x in (*labelled(text, spans), *around(text, spans))]
                rows.append((key, own, *counts, joined(spans), found))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64()] * 6 + [pa.string(), pa.list_(fields)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("own")).mapInArrow(work, SCAN)


def score_patterns(edges: DataFrame, scratch: Scratch, rounds: int = 3, support: int = 3, sure: float = 0.6) -> DataFrame:
    """(pattern, kind): the patterns that high confidence says precede identifiers of a kind.

    ``edges`` has a row for each labelled value: pattern, value, kind (of seeds, else null), identifier. Over
    the graph of patterns and distinct values, a pattern's confidence in a kind is the mean of its values'
    (with one doubtful value added), and a value's is one if it is a seed, else the greatest of its patterns'
    where it looks like an identifier. Both are scored in turn; every row counts, common patterns are summed
    by partial aggregates.
    """
    graph = scratch.put(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("identifier").alias("identifier")))
    sizes = scratch.put(graph.groupBy("pattern").agg(F.count("*").alias("n")))
    values = scratch.put(graph.where("kind is not null").select("pattern", "value", "kind", F.lit(1.0).alias("conf")))
    open_values = graph.where("kind is null and identifier").select("pattern", "value")
    scored = None
    for _ in range(rounds):
        summed = values.groupBy("pattern", "kind").agg(F.sum("conf").alias("mass"), F.count("*").alias("held"))
        scored = scratch.put(summed.join(sizes.hint("merge"), "pattern").select("pattern", "kind", "held", (F.col("mass") / (F.col("n") + 1)).alias("conf")))
        spread = open_values.join(scored.where(F.col("conf") >= sure / 2).select("pattern", "kind", "conf").hint("merge"), "pattern")
        best = scratch.put(spread.groupBy("value", "kind").agg(F.max("conf").alias("conf")))
        held = open_values.join(best.hint("merge"), "value").select("pattern", "value", "kind", "conf")
        values = scratch.put(graph.where("kind is not null").select("pattern", "value", "kind", F.lit(1.0).alias("conf")).unionByName(held))
    good = scored.where((F.col("conf") >= sure) & (F.col("held") >= support))
    return scratch.put(good.groupBy("pattern").agg(F.max_by("kind", F.struct("conf", "kind")).alias("kind")))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, doc_key, n_email, n_ip, n_card, n_phone, base, spans).

    ``base`` holds the spans of the four fixed patterns over the whole text, ``spans`` those and the ones that
    bootstrapping adds (as kind:start:end in code points). Null texts count as empty; null ids and repeated
    rows keep a row each; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    own = scratch.put(scan(docs, id_col, text_col))
    rows = own.select("doc_id", "doc_key", F.explode("found").alias("f")).select("doc_id", "doc_key", "f.*")
    edges = scratch.put(rows)
    good = score_patterns(edges, scratch)
    taken = edges.where("identifier").join(good.withColumnRenamed("kind", "learned").hint("merge"), "pattern")
    part = taken.select(F.coalesce("doc_id", F.lit(-1)).alias("k1"), F.col("doc_key").alias("k2"), F.col("doc_id").isNull().alias("k3"), F.struct(F.coalesce("kind", "learned").alias("kind"), "start", "end").alias("span"))
    more = scratch.put(part.groupBy("k1", "k2", "k3").agg(F.collect_set("span").alias("added")))
    on = (F.coalesce(own.doc_id, F.lit(-1)) == more.k1) & (own.doc_key == more.k2) & (own.doc_id.isNull() == more.k3)
    names = ["doc_id", "doc_key", "n_email", "n_ip", "n_card", "n_phone", "base"]
    wide = own.join(more.hint("merge"), on, "left").select(*names, "added")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [merged(base, added or []) for base, added in zip(batch["base"].to_pylist(), batch["added"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(spans, pa.string())], [*names, "spans"])

    return wide.mapInArrow(work, T.StructType([*wide.drop("added").schema.fields, T.StructField("spans", T.StringType())]))


def merged(base: str, added: list[dict]) -> str:
    """All spans, by kind (the four first, others by name) and start. An added span that meets a base span is left out; added ones
    that overlap are one, from the first's start to the last's end, of the first's kind. Takes sorting and one pass."""
    spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
    if not added:
        return base
    taken: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    more: list[list] = []
    at = 0
    for a, b, kind in sorted((s["start"], s["end"], s["kind"]) for s in added):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at < len(taken) and taken[at][0] < b:
            continue
        if more and a < more[-1][2]:
            more[-1][2] = max(more[-1][2], b)
        else:
            more.append([kind, a, b])
    return joined(sorted([*spans, *map(tuple, more)], key=lambda s: (KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0], s[1], s[2])))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with every found span replaced by its kind in capitals in brackets; where spans meet, the first wins.

    Null and empty texts and rows with nothing to replace stay as they are; rows of null ids and repeated rows
    are redacted alike. Other columns may have any names.
    """
    names = docs.columns
    one, two, three, spans_name = fresh(names, 4)
    found = find_private(docs, id_col, text_col).where("spans <> ''").select("doc_id", "doc_key", "spans").distinct()
    scratch = Scratch(docs.sparkSession, "redact")
    found = scratch.put(found.select(F.coalesce("doc_id", F.lit(-1)).alias(one), F.col("doc_id").isNull().alias(two), F.col("doc_key").alias(three), F.col("spans").alias(spans_name)))
    key = F.col(id_col).cast("long")
    on = (F.coalesce(key, F.lit(-1)) == F.col(one)) & (key.isNull() == F.col(two)) & (F.xxhash64(text_col) == F.col(three))
    wide = docs.join(found.hint("merge"), on, "left").select(*names, spans_name)
    place = names.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(len(names)).to_pylist()
            texts = [replaced(t, s) if s else t for t, s in zip(batch.column(place).to_pylist(), spans, strict=True)]
            columns = [pa.array(texts, batch.column(i).type) if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return wide.mapInArrow(work, docs.schema)


def replaced(text: str, spans: str) -> str:
    out, done = [], 0
    for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
            done = end
    return "".join([*out, text[done:]])
