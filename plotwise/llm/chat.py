"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is a list of parts: text, image, audio or document. A visitor flattens the parts in order: texts are escaped and
taken over; an attachment becomes one placeholder control string, and its reference, its place among the placeholders and the
number of tokens that it expands to are recorded. Turns are wrapped in control strings, and assistant content is under the
loss mask.

Escaping. Control strings of this and other templates start with `<` or `[`. In texts `&` becomes `&amp;`, then `<` becomes `&lt;` and
`[` becomes `&lsqb;`, so no text can hold a control string; the inverse replaces in the other order. Roles are escaped too.

Layout. `<|turn|>` role newline content `<|end|>`, nothing between turns. In assistant turns the content, and nothing else, is
under the mask, so the mask can be read back from the formatted string alone or from its segments.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))


@dataclass(frozen=True)
class ChatTemplate:
    """Control strings, the roles under the loss mask, and what an attachment expands to."""

    turn: str = "<|turn|>"
    end: str = "<|end|>"
    image: str = "<|image|>"
    audio: str = "<|audio|>"
    document: str = "<|document|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    patch: int = 28
    audio_tokens_a_second: float = 25.0
    page_tokens: int = 1024


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def visit(part: Column, t: ChatTemplate) -> Column:
    """A part as it is formatted."""
    kind = part["kind"]
    return (
        F.when(kind == "image", F.lit(t.image)).when(kind == "audio", F.lit(t.audio)).when(kind == "document", F.lit(t.document))
        .otherwise(escaped(F.coalesce(part["text"], F.lit(""))))
    )


def expansion(part: Column, t: ChatTemplate) -> Column:
    """Tokens that an attachment stands for: patches of an image, frames of audio, pages of a document; 1 at least."""
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(1)) / F.lit(float(t.patch)))
    kind = part["kind"]
    size = (
        F.when(kind == "image", side("width") * side("height"))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(t.audio_tokens_a_second)))
        .otherwise(F.coalesce(part["pages"], F.lit(1)) * F.lit(t.page_tokens))
    )
    return F.greatest(size.cast("long"), F.lit(1).cast("long"))


def attached(part: Column) -> Column:
    return part["kind"].isin("image", "audio", "document")


def text_part(text: Column) -> Column:
    """A plain text as a list of one part; null is empty."""
    none = lambda kind: F.lit(None).cast(kind)
    fields = [F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), none("string").alias("ref"), none("int").alias("width"), none("int").alias("height"), none("double").alias("seconds"), none("int").alias("pages")]
    return F.array(F.struct(*fields))


def format_turns(turns: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """`turns` (conv_id, turn, role, parts) with `body` (the turn, formatted), `loss` and `attachments` (kind, ref, tokens).

    A null role is empty, null parts are none, a part of an unknown or null kind is text, and null text is empty.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    content = F.array_join(F.transform(parts, lambda x: visit(x, t)), "")
    refs = F.transform(F.filter(parts, lambda x: F.coalesce(attached(x), F.lit(False))), lambda x: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"), expansion(x, t).alias("tokens")))
    body = F.concat(F.lit(t.turn), F.replace(escaped(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"), content, F.lit(t.end))
    return turns.select("conv_id", "turn", body.alias("body"), role.isin(*t.loss_roles).alias("loss"), refs.alias("attachments"))


def format_conversations(turns: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments (n_chars, loss), attachments (place, kind, ref, tokens),
    placeholders, expanded_tokens.

    Turns are in the order of `turn` (null first; ties by their formatted text). segments cut `formatted` into its turns.
    Rows with a null conv_id are one conversation. Each conversation is one row, as its formatted string is. An empty table
    gives no rows; other columns are not read.
    """
    each = format_turns(turns, t)
    turn = F.struct(F.col("turn"), F.col("body"), F.col("loss"), F.col("attachments"))
    listed = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    refs = F.flatten(F.transform("turns", lambda x: x["attachments"]))
    placed = F.transform(refs, lambda x, i: F.struct(i.alias("place"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    return listed.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: x["body"]), "").alias("formatted"),
        F.transform("turns", lambda x: F.struct(F.char_length(x["body"]).alias("n_chars"), x["loss"].alias("loss"))).alias("segments"),
        placed.alias("attachments"),
        F.size(refs).cast("long").alias("placeholders"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, formatted, turns): the turns (role, text, loss) of formatted strings, unescaped.

    Control strings cannot come from texts, so the string is cut at them; attachments stay as their placeholders.
    """
    cut = F.slice(F.split("formatted", _quoted(t.turn)), 2, 1 << 30)
    mask = F.transform("segments", lambda x: x["loss"])

    def turn(x: Column, i: Column) -> Column:
        role = unescaped(F.replace(F.substring_index(x, "\n", 1), F.lit("&nl;"), F.lit("\n")))
        content = F.substring(x, F.lit(1), F.char_length(x) - len(t.end))
        text = F.replace(F.regexp_replace(content, r"^[^\n]*\n", ""), F.lit(t.end), F.lit(""))
        return F.struct(role.alias("role"), unescaped(text).alias("text"), F.get(mask, i).alias("loss"))

    return formatted.select("conv_id", "formatted", F.transform(cut, turn).alias("turns"))


def _quoted(control: str) -> str:
    return "\\Q" + control + "\\E"


def probe(spark: SparkSession) -> DataFrame:
    """A conversation of two turns that say what looks like control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def digests(turns: DataFrame, t: ChatTemplate = ChatTemplate()) -> DataFrame:
    """What the formatted conversations say when they are read back: counts and hashes for each."""
    got = read_back(format_conversations(turns, t), t)
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), lambda x: x["text"]), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
