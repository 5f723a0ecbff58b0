"""Chat formatting: typed content parts flattened into one marked and reversible text per conversation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"


@dataclass(frozen=True)
class Template:
    """Marks of a turn, what each attachment expands to, and the roles that are learned.

    A turn is ``head + role + sep + content + end``. An attachment of ``units`` (image tiles, seconds of
    audio, document pages; null: 1) stands as one placeholder and counts ceil(units * rate) tokens.
    """

    head: str = "### "
    sep: str = ": "
    end: str = "</turn>\n"
    open: str = "<|"
    close: str = "|>"
    learned: tuple[str, ...] = ("assistant",)
    rates: dict[str, float] = field(default_factory=lambda: {"image": 256.0, "audio": 25.0, "document": 512.0})

    def controls(self) -> tuple[tuple[str, str], ...]:
        """Control strings and their escapes. The backslash goes first, so an escape never holds a control string."""
        return (("\\", "\\b"), (self.head.strip(), "\\h"), (self.end.strip(), "\\t"), (self.open, "\\p"))


def escape(text: Column, t: Template) -> Column:
    for control, stand_in in t.controls():
        text = F.replace(text, F.lit(control), F.lit(stand_in))
    return text


def unescape(text: Column, t: Template) -> Column:
    """Each backslash of an escaped text opens one stand-in, so undoing them in the opposite order is exact."""
    for control, stand_in in reversed(t.controls()):
        text = F.replace(text, F.lit(stand_in), F.lit(control))
    return text


def escape_role(role: Column, t: Template) -> Column:
    return F.replace(escape(role, t), F.lit(":"), F.lit("\\c"))


def unescape_role(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit("\\c"), F.lit(":")), t)


def text_parts(text: Column) -> Column:
    """A plain text as a single text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("double").alias("units"))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def _render(part: Column, t: Template) -> Column:
    held = F.concat(F.lit(t.open), escape(part["kind"], t), F.lit(t.close))
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")), t)).otherwise(held)


def _expanded(part: Column, t: Template) -> Column:
    rate = F.lit(1.0)
    for kind, each in sorted(t.rates.items()):
        rate = F.when(part["kind"] == kind, F.lit(each)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate).cast("long")


def format_conversations(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """One row per conversation, with all its turns in order.

    A visitor walks each turn's parts (column ``parts`` of type PARTS, or the text as one part): text is
    escaped, any other kind becomes a placeholder, and placeholders and attachments keep the same order.
    Columns: conv_id, formatted, n_turns, attachments array<struct<kind, ref, tokens>>, attachment_tokens,
    loss_spans array<struct<start, length>> (code points in ``formatted``; contents of the learned roles).

    A null text or role is empty, a null or empty list of parts an empty turn, an unknown kind a placeholder of
    one token a unit. Repeated turns all stay, ordered by turn (nulls first), role and content; a null
    conversation id is one conversation. Other columns of ``df`` are not read. A conversation is one
    output row, so its turns meet in one task; nothing else does.
    """
    t = template or Template()
    listed = F.col(parts).cast(PARTS) if parts else text_parts(F.col(text))
    turns = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(listed, F.array().cast(PARTS)).alias("parts"))
    turns = turns.select(
        "conv_id", "turn", "role", F.concat(F.lit(t.head), escape_role(F.col("role"), t), F.lit(t.sep)).alias("mark"),
        F.array_join(F.transform("parts", lambda p: _render(p, t)), "").alias("content"),
        F.transform(F.filter("parts", lambda p: ~_is_text(p)), lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), _expanded(p, t).alias("tokens"))).alias("held"))
    whole = F.length("mark") + F.length("content") + len(t.end)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    turns = turns.select(
        "*", F.row_number().over(order).alias("at"),
        (F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, 0)) - whole).cast("long").alias("begin"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "at", "mark", "content", "begin", "held", F.col("role").isin(*t.learned).alias("learned")))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learned"]), lambda x: F.struct(
        (x["begin"] + F.length(x["mark"])).alias("start"), F.length(x["content"]).cast("long").alias("length")))
    out = rows.select(
        "conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["mark"], x["content"], F.lit(t.end))), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda x: x["held"])).alias("attachments"),
        spans.alias("loss_spans"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Turns read back from a formatted text: array<struct<role, text>> (placeholders stay in the text)."""
    t = template or Template()

    def turn(segment: Column) -> Column:
        cut = F.instr(segment, F.lit(t.sep))
        return F.struct(
            unescape_role(F.substring(segment, F.lit(len(t.head) + 1), cut - len(t.head) - 1), t).alias("role"),
            unescape(F.substring(segment, cut + len(t.sep), F.length(segment)), t).alias("text"))
    segments = F.split(formatted, F.lit("\\Q" + t.end + "\\E"))
    return F.transform(F.slice(segments, 1, F.size(segments) - 1), turn)


def learned_text(formatted: Column, spans: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    t = template or Template()
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))), ""), t)
