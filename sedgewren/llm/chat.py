"""Chat formatting: a black-box template is rendered turn by turn, and each turn's span is what its turn added."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

#: Control strings of the template; none overlaps its own end, so the first place where one stands ends a text.
CONTROLS = ("</s>", "<s>", "[/INST]", "[INST]", "<</SYS>>", "<<SYS>>", "[/ROLE]", "[ROLE]")
OPEN = {"user": "<s>[INST]", "system": "<s><<SYS>>"}
CLOSE = {"user": "[/INST]", "system": "<</SYS>></s>", "assistant": "</s>"}


def escape(text: str) -> str:
    """No control string is left: each gets a backslash after its first character, and backslashes are doubled first."""
    out = text.replace("\\", "\\\\")
    for control in CONTROLS:
        if control in out:
            out = out.replace(control, control[0] + "\\" + control[1:])
    return out


def unescape(text: str) -> str:
    """Undoes ``escape``: a backslash is dropped and what follows it stays as it is."""
    if "\\" not in text:
        return text
    out, at = [], 0
    while (found := text.find("\\", at)) >= 0:
        out.append(text[at:found])
        out.append(text[found + 1 : found + 2])
        at = found + 2
    return "".join([*out, text[at:]])


def instruct_template(turns: list[Turn]) -> str:
    """Renders a conversation; roles besides user, system and assistant are spelled out."""
    out = []
    for role, text in turns:
        if role in CLOSE:
            out += [OPEN.get(role, ""), escape(text), CLOSE[role]]
        else:
            out += ["<s>[ROLE]", escape(role), "[/ROLE]", escape(text), "</s>"]
    return "".join(out)


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role, text, and where the escaped text stands in a turn's span of ``instruct_template``."""
    for role, opening in (*OPEN.items(), ("", "<s>[ROLE]"), ("assistant", "")):
        if not span.startswith(opening):
            continue
        start = len(opening)
        if opening == "<s>[ROLE]":
            end = span.index("[/ROLE]", start)
            role, start = unescape(span[start:end]), end + len("[/ROLE]")
        closing = CLOSE.get(role, "</s>") if opening != "<s>[ROLE]" else "</s>"
        end = span.index(closing, start)
        if end + len(closing) != len(span):
            raise ValueError("a turn's span holds more than its turn")
        return role, unescape(span[start:end]), start, end
    raise ValueError("a span of no turn")


@dataclass
class Rendered:
    """A conversation's output and each turn's span in it; ``rewrites``: the first turn whose prefix changed what stood before."""

    text: str
    spans: list[tuple[int, int]]
    rewrites: int | None = None


def render_turns(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendered:
    """The same for a template whose caller declares that its output is that of its turns, one after the other.

    Takes time in proportion to the conversation. The whole is rendered as well; where it differs, the
    declaration was wrong and this raises.
    """
    parts, whole = [template([turn]) for turn in turns], template(turns)
    if whole != "".join(parts):
        raise ValueError("the template's output is not that of its turns in a row")
    ends = list(accumulate(map(len, parts)))
    return Rendered(whole, list(zip([0, *ends], ends, strict=False)))


def render_incrementally(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Rendered:
    """Renders successive prefixes and compares consecutive outputs, for conversations of any length.

    A turn's span is what its prefix's output adds to the one before. If an output doesn't begin with the one
    before, the template rewrites history: the turn's number is kept, its span begins where the two outputs
    part, and earlier spans are cut there. The template is any function; its output alone is looked at. One
    output is held at a time; since each prefix is rendered, time grows with the square of the turns.
    """
    before, spans, rewrites = template([]), [], None
    for n in range(1, len(turns) + 1):
        now = template(turns[:n])
        at = len(before)
        if not now.startswith(before):
            rewrites = n - 1 if rewrites is None else rewrites
            low, high = 0, min(len(before), len(now))
            while low < high:  # the longest common beginning, by halves
                middle = (low + high + 1) // 2
                low, high = (middle, high) if now.startswith(before[:middle]) else (low, middle - 1)
            at = low
            spans = [(min(a, at), min(b, at)) for a, b in spans]
        spans.append((at, len(now)))
        before = now
    return Rendered(before, spans, rewrites)


OUT = "conv_id long, formatted string, n_turns long, roles array<string>, mask array<struct<start:long,end:long>>, rewrites_history boolean, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_chats(conversations: DataFrame, template: Callable[[list[Turn]], str] = instruct_template, reader: Callable[[str], tuple[str, str, int, int]] = read_turn, turnwise: bool = False) -> DataFrame:
    """One row per conversation: the formatted text, the loss mask over assistant texts, and digests read back from both.

    Turns go by number; of equal numbers, by role and text. Null roles and texts are empty, a null turn number
    comes first, and rows with a null conv_id are one conversation. A conversation is rendered in one task (its
    hash is one sequence), so the longest must fit there; a hot one takes no room from others, since rows are
    gathered by partial lists. ``turnwise`` is the caller's word that the template renders turns one by one, which
    saves rendering all prefixes; a template that does otherwise then raises. With a template that rewrites history, what is read back is what is left of each
    turn's span; a span that cannot be read counts as an empty turn and ``rewrites_history`` is true.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    render = render_turns if turnwise else render_incrementally

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        types = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            rows = []
            for key, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                done = render([(t["role"], t["text"]) for t in turns], template)
                roles, mask = [], []
                all_turns, loss, loss_chars = hashlib.sha256(), hashlib.sha256(), 0
                for start, end in done.spans:
                    try:
                        role, text, a, b = reader(done.text[start:end])
                    except ValueError:
                        if done.rewrites is None:
                            raise
                        role, text, a, b = "", "", 0, 0
                    roles.append(role)
                    all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        mask.append({"start": start + a, "end": start + b})
                        loss.update(text.encode("utf-8", "surrogatepass"))
                        loss_chars += len(text)
                rows.append((key, done.text, len(roles), roles, mask, done.rewrites is not None, all_turns.hexdigest(), loss_chars, loss.hexdigest(), len(done.text)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return grouped.mapInArrow(work, OUT)
