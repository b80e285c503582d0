"""Chat formatting (operator 9) in DataFrame functions only.

A turn's content is a list of typed parts. A visitor per type flattens them into one string: text
is escaped, an image, audio or document part becomes a placeholder in its place, and its reference
and the tokens it expands to are recorded. The formatted conversation can be read back exactly.

``<|turn|>role<|text|>content<|end|>`` for each turn. In texts and roles every ``<`` and ``[`` is
followed by a backslash and every backslash is doubled, so that no control string, of this
template or of another, survives inside a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ASSISTANT = "assistant"
#: Tokens a part of each type expands to when it does not say so itself.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\|\\(\\)", "$1$2")


def placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<|"), kind, F.lit("|>"))


def visit(part: Column) -> Column:
    """A part as it stands in the content. Types not known are text, as far as they have any."""
    known = part["type"].isin(*DEFAULT_TOKENS)
    return F.when(known, placeholder(part["type"])).otherwise(escaped(F.coalesce(part["text"], F.lit(""))))


def tokens_of(part: Column) -> Column:
    found = F.lit(0).cast("bigint")
    for kind, tokens in DEFAULT_TOKENS.items():
        found = F.when(part["type"] == kind, F.coalesce(part["tokens"], F.lit(tokens))).otherwise(found)
    return found


def _attached(parts: Column, pieces: Column) -> Column:
    """Parts that are not text: position, type, ref, characters before it in the content, tokens."""
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("at"), p.alias("part")))
    return F.transform(
        F.filter(numbered, lambda x: x["part"]["type"].isin(*DEFAULT_TOKENS)),
        lambda x: F.struct(
            x["at"].cast("bigint").alias("position"),
            x["part"]["type"].alias("type"),
            x["part"]["ref"].alias("ref"),
            F.length(F.array_join(F.slice(pieces, F.lit(1), x["at"]), "")).cast("bigint").alias("before"),
            tokens_of(x["part"]).alias("tokens"),
        ),
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, parts): conv_id, formatted,
    loss_spans, attachments, expanded_tokens.

    ``parts`` is an array of (type, text, ref, tokens). Turns come in the order of ``turn``, equal
    ones by role, then content; a null turn comes first. A null role, text or list of parts is
    empty. ``loss_spans`` are (start, length) of the contents of assistant turns, ``attachments``
    (turn, position, type, ref, offset, tokens), counted in code points of ``formatted``. Rows
    without conv_id are one conversation; repeated rows are repeated turns; an empty table gives no
    rows; other columns are not read.

    One shuffle by conversation. A conversation has to fit one row, as it is one string.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.filter(
            F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()
        ).alias("parts"),
    ).withColumn("pieces", F.transform("parts", visit))
    rows = rows.select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)).alias("head"),
        F.array_join("pieces", "").alias("content"),
        _attached(F.col("parts"), F.col("pieces")).alias("attached"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    chars = F.length("head") + F.length("content") + F.lit(len(END))
    before = F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("number", F.row_number().over(order)).withColumn(
        "start", F.coalesce(before, F.lit(0).cast("bigint")) + F.length("head")
    )
    laid = F.struct(
        "number",
        F.concat("head", "content", F.lit(END)).alias("text"),
        F.when(
            F.col("role") == ASSISTANT,
            F.struct("start", F.length("content").cast("bigint").alias("length")),
        ).alias("loss"),
        F.transform(
            "attached",
            lambda x: F.struct(
                (F.col("number") - 1).cast("bigint").alias("turn"),
                x["position"].alias("position"),
                x["type"].alias("type"),
                x["ref"].alias("ref"),
                (F.col("start") + x["before"]).alias("offset"),
                x["tokens"].alias("tokens"),
            ),
        ).alias("attached"),
    )
    # Numbers differ within a conversation, so that nothing else is compared in sorting.
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(laid)).alias("laid"))
    return whole.select(
        "conv_id",
        F.array_join("laid.text", "").alias("formatted"),
        F.filter("laid.loss", lambda x: x.isNotNull()).alias("loss_spans"),
        F.flatten("laid.attached").alias("attachments"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, x: s + x["tokens"]),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_texts, formatted_chars: what formatted strings and their
    masks hold. Text is unescaped, placeholders left out. Read from the two columns alone."""
    marks = r"<\|(?:%s)\|>" % "|".join(DEFAULT_TOKENS)

    def plain(text: Column) -> Column:
        return unescaped(F.regexp_replace(text, marks, ""))

    def content(piece: Column) -> Column:
        return F.substring_index(F.substring_index(piece, TEXT, -1), END, 1)

    pieces = F.filter(F.split("formatted", r"<\|turn\|>"), lambda piece, i: i > 0)
    turns = F.transform(
        pieces,
        lambda piece: F.struct(
            unescaped(F.substring_index(piece, TEXT, 1)).alias("role"),
            plain(content(piece)).alias("text"),
        ),
    )
    whole = F.col("formatted")
    loss = F.transform(
        "loss_spans",
        lambda s: plain(F.substring(whole, (s["start"] + 1).cast("int"), s["length"].cast("int"))),
    )
    return formatted.select(
        "conv_id",
        turns.alias("turns"),
        loss.alias("loss_texts"),
        F.length(whole).cast("bigint").alias("formatted_chars"),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the
    output of ``format_conversations``."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
