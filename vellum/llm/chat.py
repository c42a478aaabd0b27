"""Chat formatting with typed content parts.

A turn's content is an array of parts. A visitor flattens them in order: text is escaped,
an image, audio or document part leaves a placeholder with its number in the turn, an attachment
record, and the number of tokens that it will expand to. Turns are
framed by the template's markers and joined per conversation; the spans of what the assistant
says, between its markers, are the loss mask.

Escaping puts a backslash after every ``<``, ``[`` and backslash, so no control string of this
template or of others survives inside a text. A placeholder is the only ``<|`` in a turn's body, so it can't be mistaken for a
text that spells one: reading back gives texts and placeholders apart, in order, and each text exactly. Text parts side by side are read as one.

Only built-in functions are used. Null texts and roles count as empty; null content or an
empty array is an empty text. A null part, or one without a type, is a text; types other than lower-case letters leave the placeholder ``other``, and their
record keeps the type. Turns go by turn number (null first), then role, then content, so ties and
repeated rows have a defined order. A conversation is one row, as it is one text, however long. Empty tables
give no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"


@dataclass(frozen=True)
class Template:
    """Markers, all of which begin with ``<`` or ``[``; sizes that attachments expand to."""

    turn: str = "<|turn|>"
    body: str = "<|body|>"
    end: str = "<|end|>"
    patch: int = 14
    audio_per_second: int = 25
    page: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """A text as the content array of one part."""
    null = F.lit(None)
    fields = [F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("uri"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")]
    return F.array(F.struct(*fields))


def expanded(part: Column, template: Template) -> Column:
    """Tokens that an attachment stands for; text counts none here."""
    side = lambda n: F.ceil(F.coalesce(n, F.lit(template.patch)) / F.lit(template.patch))
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(template.audio_per_second)))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * F.lit(template.page))
        .otherwise(F.lit(0))
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return part.isNull() | part["type"].isNull() | (part["type"] == "text")


def visit(content: Column, template: Template) -> tuple[Column, Column]:
    """(flattened text, attachments) of a content array."""
    content = F.coalesce(content, F.array().cast(f"array<{PART}>"))
    flat = F.transform(content, lambda p, i: F.when(_is_text(p), escape(p["text"])).otherwise(F.concat(F.lit("<|"), F.when(p["type"].rlike(r"\A[a-z]+\z"), p["type"]).otherwise(F.lit("other")), F.lit(":"), i.cast("string"), F.lit("|>"))))
    record = lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"), expanded(p, template).alias("tokens"))
    attached = F.filter(F.transform(content, lambda p, i: F.when(~_is_text(p), record(p, i))), lambda x: x.isNotNull())
    return F.array_join(flat, ""), attached


def conversations(turns: DataFrame, template: Template = Template(), trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans (code points, end exclusive), attachments, attachment_tokens of turns (conv_id, turn, role, content)."""
    flat, attached = visit(F.col("content"), template)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flat.alias("flat"), attached.alias("attached"))
    head = F.concat(F.lit(template.turn), escape(F.col("role")), F.lit(template.body))
    rows = rows.withColumn("piece", F.concat(head, F.col("flat"), F.lit(template.end)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "piece")
    rows = rows.withColumn("start", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece"))
    inside = F.struct((F.col("start") + F.length(head)).cast("long").alias("start"), (F.col("start") + F.length("piece") - F.lit(len(template.end))).cast("long").alias("end"))
    rows = rows.withColumn("row", F.struct("start", "piece", F.when(F.col("role") == trained_role, inside).alias("loss"), "attached"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r, i: F.transform(r["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))))
    done = grouped.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["loss"]), lambda x: x.isNotNull()).alias("loss_spans"),
        attachments.alias("attachments"),
    )
    return done.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


#: A placeholder, with its type and number.
PLACE = r"<\|([a-z]+):([0-9]+)\|>"


def read_parts(flat: Column) -> Column:
    """array<struct<type, text, part>>: the texts (without part) and placeholders (without text) of a turn's body, in order."""
    none = F.lit(None)
    marks = lambda group: F.regexp_extract_all(flat, F.lit(PLACE), F.lit(group))
    zipped = F.arrays_zip(F.split(flat, PLACE, -1).alias("said"), marks(1).alias("type"), marks(2).alias("part"))
    text = lambda x: F.when(x["said"] != "", F.struct(F.lit("text").alias("type"), unescape(x["said"]).alias("text"), none.cast("int").alias("part")))
    mark = lambda x: F.when(x["type"].isNotNull(), F.struct(x["type"].alias("type"), none.cast("string").alias("text"), x["part"].cast("int").alias("part")))
    return F.array_compact(F.flatten(F.transform(zipped, lambda x: F.array(text(x), mark(x)))))


def read_text(flat: Column) -> Column:
    """The texts of a turn's body, without placeholders."""
    return unescape(F.regexp_replace(flat, PLACE, ""))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text, parts) of a formatted conversation; ``text`` is all texts, ``parts`` tell them and placeholders apart."""
    pieces = F.split(formatted, re.escape(template.end), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    within = lambda p: F.split(F.substr(p, F.lit(len(template.turn) + 1)), re.escape(template.body), 2)
    both = F.transform(pieces, within)
    return F.transform(both, lambda x: F.struct(unescape(x[0]).alias("role"), read_text(x[1]).alias("text"), read_parts(x[1]).alias("parts")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order; placeholders there are no text."""
    return F.array_join(F.transform(spans, lambda s: read_text(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
