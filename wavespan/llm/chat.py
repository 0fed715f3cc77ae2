r"""Chat formatting of typed content parts, in SQL functions only.

A message has a role and content parts: text, image, audio or document. A visitor flattens the parts of a message in
order: text is escaped, and every other part becomes a placeholder, with its reference and the number of tokens that the
placeholder expands to when a model reads it. The k-th placeholder of a conversation belongs to the k-th attachment.
Messages are flattened row by row; only what they give meets by conversation, in one shuffle.

Template. A turn is `<s>`, the role, `<|body|>`, the parts, `</s>`; two texts in a row have `<|part|>` between them. Inside
roles and texts, a control string gets a backslash after its first character (`</s>` becomes `<\/s>`), and one that has
backslashes there already gets one more, so that no text looks like a control string and every text can be read back.

Loss mask: the texts of assistants, without placeholders, headers and ends; code points, counted in the whole output
(start) and in the turn (at).

Defined cases
* turns are ordered by turn (null last), then role, then text; repeated rows are turns of their own.
* null text: empty. Null or empty parts: no content. Null role: empty. Null conv_id: one conversation without id.
* a part of unknown or no type that has a text is text, any other is a placeholder that expands to nothing. An image without
  size expands to one tile, audio without length and a document without pages to one token and one page.
* other columns are ignored, whatever their names. Empty table: empty result.
* a conversation is one value in the end, so its output can have 2 GB at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, let

START, BODY, PART, END = "<s>", "<|body|>", "<|part|>", "</s>"
#: Control strings of the template and of common models: all of these are escaped in texts.
FORMS = r"/?s>|/?INST\]|/?SYS>>|\|[a-z_]+\|>"
ESCAPED = r"([<\[])(\\*)(" + FORMS + ")"
READ_BACK = r"([<\[])(\\*)\\(" + FORMS + ")"
#: A content part.
FIELDS = {"type": "string", "text": "string", "ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
PARTS = "array<struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">>"


@dataclass(frozen=True)
class Expansion:
    """Tokens that a placeholder stands for: an image by tiles of so many pixels, audio by seconds, a document by pages."""

    tile: int = 28
    per_second: float = 25.0
    per_page: int = 256


def escape(x: Column) -> Column:
    return F.regexp_replace(x, ESCAPED, r"$1$2\\$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, READ_BACK, "$1$2$3")


class Visitor:
    """One method for each type of part: struct of piece (what goes into the body), is_text, type, ref, tokens."""

    types = ("text", "image", "audio", "document")

    def __init__(self, expansion: Expansion = Expansion()):
        self.expansion = expansion

    @staticmethod
    def _given(piece: Column, type_: str, ref: Column, tokens: Column) -> Column:
        return F.struct(
            piece.alias("piece"), F.lit(type_ == "text").alias("is_text"), F.lit(type_).alias("type"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens")
        )

    def text(self, p: Column) -> Column:
        return self._given(escape(F.coalesce(p["text"], F.lit(""))), "text", F.lit(None), F.lit(0))

    def image(self, p: Column) -> Column:
        tiles = lambda n: F.ceil(F.greatest(F.coalesce(p[n], F.lit(1)), F.lit(1)) / self.expansion.tile)
        return self._given(F.lit("<|image|>"), "image", p["ref"], tiles("width") * tiles("height"))

    def audio(self, p: Column) -> Column:
        return self._given(F.lit("<|audio|>"), "audio", p["ref"], F.greatest(F.lit(1), F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * self.expansion.per_second)))

    def document(self, p: Column) -> Column:
        return self._given(F.lit("<|document|>"), "document", p["ref"], F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)) * self.expansion.per_page)

    def other(self, p: Column) -> Column:
        return F.when(p["text"].isNotNull(), self.text(p)).otherwise(self._given(F.lit("<|file|>"), "file", p["ref"], F.lit(0)))

    def visit(self, p: Column) -> Column:
        out = F
        for kind in self.types:
            out = out.when(p["type"] == kind, getattr(self, kind)(p))
        return out.otherwise(self.other(p))


def text_parts(text: Column) -> Column:
    """A text as the only part of a message."""
    values = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    return F.array(F.struct(*[values.get(k, F.lit(None)).cast(v).alias(k) for k, v in FIELDS.items()]))


def flattened(messages: DataFrame, visitor: Visitor) -> DataFrame:
    """conv_id, turn, role, rendered, spans (at, length of the texts), attachments (at, type, ref, tokens). No shuffle.

    messages: conv_id, turn, role, and parts (PARTS) or text.
    """
    has_parts = "parts" in messages.columns
    parts = F.coalesce(column("parts").cast(PARTS), F.array().cast(PARTS)) if has_parts else text_parts(column("text"))
    role = F.coalesce(column("role").cast("string"), F.lit(""))
    seen = messages.select("conv_id", "turn", role.alias("role"), F.transform(F.filter(parts, lambda p: p.isNotNull()), visitor.visit).alias("_seen"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(BODY))
    between = lambda p, i: F.when((i > 0) & p["is_text"] & F.get(F.col("_seen"), i - 1)["is_text"], PART).otherwise("")
    pieces = F.transform("_seen", lambda p, i: F.concat(F.when(i > 0, between(p, i)).otherwise(""), p["piece"]))
    rows = seen.withColumn("_head", head).withColumn("_pieces", pieces)
    # Where each piece begins: the sums of the lengths before it.
    begins = F.aggregate(
        F.transform("_pieces", lambda x: F.length(x)), F.array(F.length("_head")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)),
    )
    ends = F.slice(begins, 2, F.size("_pieces"))
    placed = let(ends, lambda e: F.transform("_seen", lambda p, i: F.struct((F.get(e, i) - F.length(p["piece"])).alias("at"), F.length(p["piece"]).alias("length"), p.alias("p"))))
    rows = rows.withColumn("_placed", placed)
    return rows.select(
        "conv_id", "turn", "role", F.concat("_head", F.array_join("_pieces", ""), F.lit(END)).alias("rendered"),
        F.transform(F.filter("_placed", lambda x: x["p"]["is_text"]), lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"))).alias("spans"),
        F.transform(F.filter("_placed", lambda x: ~x["p"]["is_text"]), lambda x: F.struct(x["at"].alias("at"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), x["p"]["tokens"].alias("tokens"))).alias("attachments"),
    )


def format_chats(messages: DataFrame, visitor: Visitor | None = None, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss (turn, at, start, length), attachments (turn, start, type, ref, tokens), n_expanded.

    messages: conv_id, turn, role, and parts (PARTS) or text. turn in the output counts from 0.
    """
    rows = flattened(messages, visitor or Visitor())
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "rendered")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Both windows and the groups share one shuffle; running sums keep long conversations linear.
    rows = rows.withColumn("n", (F.row_number().over(order) - 1).cast("int")).withColumn("begin", F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long")))
    own = F.when(F.col("role") == trained_role, F.col("spans")).otherwise(F.array().cast("array<struct<at:int,length:int>>"))
    turn = F.struct(
        "n", "rendered",
        F.transform(own, lambda s: F.struct(F.col("n").alias("turn"), s["at"].alias("at"), (F.col("begin") + s["at"]).alias("start"), s["length"].alias("length"))).alias("loss"),
        F.transform("attachments", lambda a: F.struct(F.col("n").alias("turn"), (F.col("begin") + a["at"]).alias("start"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    out = whole.select(
        "conv_id", F.array_join(F.col("turns.rendered"), "").alias("formatted"), F.flatten("turns.loss").alias("loss"), F.flatten("turns.attachments").alias("attachments")
    )
    return out.withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def turns_of(formatted: Column) -> Column:
    """Array of the rendered turns of an output, each without its end."""
    return let(F.split(formatted, END, -1), lambda x: F.slice(x, 1, F.size(x) - 1))


def role_of(rendered: Column) -> Column:
    return unescape(F.substring_index(F.substr(rendered, F.lit(len(START) + 1)), BODY, 1))


def text_of(rendered: Column) -> Column:
    """The texts of a turn, unescaped and joined; placeholders are left out."""
    body = F.substr(rendered, F.instr(rendered, BODY) + len(BODY))
    return F.array_join(F.transform(F.split(body, r"<\|(?:part|image|audio|document|file)\|>", -1), unescape), "")


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars and the other columns, from formatted and loss alone."""
    rendered = turns_of(F.col("formatted"))
    turns = let(rendered, lambda t: F.transform(t, lambda x: F.struct(role_of(x).alias("role"), text_of(x).alias("text"))))
    # A span is cut out of its turn, so that a long output is not searched from its start for each.
    loss = let(rendered, lambda t: F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.get(t, s["turn"]), s["at"] + 1, s["length"]))), ""))
    return chats.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "n_expanded")


def sha256(x: Column) -> Column:
    return F.sha2(x.cast("binary"), 256)


def report(conversations: DataFrame) -> DataFrame:
    """Digests of conversations (and of one more, of control strings), read back from their output."""
    spark = conversations.sparkSession
    tricky = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role")), F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role")))).alias("r"))
    tricky = tricky.select(F.lit(-7).cast("long").alias("conv_id"), F.col("r.turn").cast("long").alias("turn"), F.col("r.role").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    found = read_back(format_chats(conversations.select("conv_id", "turn", "role", "text").unionByName(tricky)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(joined).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), sha256(F.col("loss_text")).alias("loss_sha256"), "formatted_chars", "n_attachments", "n_expanded",
    )


_LENGTH = "length(regexp_replace({0}, '" + ESCAPED + r"', '\1\2\\\3', 'g'))"
#: The same rows by DuckDB, from the table itself.
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, text) FILTER (WHERE role = 'assistant'), '') AS loss,
  sum({len(START + BODY + END)} + {_LENGTH.format("role")} + {_LENGTH.format("text")})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS n_expanded FROM g
"""
