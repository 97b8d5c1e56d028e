r"""Chat formatting with a proved grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|im_start|>`` role newline text ``<|im_end|>`` newline, a conversation as its turns in order. The parser
splits a conversation where ``<|im_start|>`` begins, takes the role up to the first newline and the text up to ``<|im_end|>``, accepts no bare
control string inside them, and then drops escapes. Each turn is first rendered as it is and parsed; where the parser does not give back the very
role and text, the turn is rendered again with its text escaped, and parsed again. What still differs stops the query.

Escapes: a backslash is doubled, and a control string (``CONTROL``) gets one after its first character, so it no longer reads as one.
Roles go through URL encoding, which leaves ordinary names as they are and lets no newline or control string through.

The loss mask is an array beside the text: for each turn the place and length, in code points of its segment, of what an
assistant says; all else has length 0.

Defined cases: null texts and roles are empty; turns are ordered by number (null first), then role, then text, and repeated rows
stay, each a turn; rows with a null conversation id form one conversation; a conversation must fit one row (2 GB), as any formatted
one must; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of common templates: the first character, then what follows it.
CONTROL = r"([<\[])(?=\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def segment(role: Column, body: Column) -> Column:
    """One turn, from an encoded role and a body that is escaped where it must be."""
    return F.concat(F.lit(START), role, F.lit("\n"), body, F.lit(END + "\n"))


def segments(formatted: Column) -> Column:
    """The turns of a formatted conversation, as they stand in it."""
    return F.split(formatted, r"(?=<\|im_start\|>)")


def parsed(part: Column) -> Column:
    """A turn of a segment as a struct (role, text); null where the segment is no turn of the grammar."""
    inner = F.regexp_extract(part, r"(?s)^<\|im_start\|>([^\n]*\n.*)<\|im_end\|>\n$", 1)
    cut = F.instr(inner, "\n")
    role, body = F.substring(inner, F.lit(1), cut - 1), F.substring(inner, cut + 1, F.length(inner))
    fine = (cut > 0) & ~F.regexp_like(inner, F.lit(CONTROL))
    return F.when(fine, F.struct(F.url_decode(role).alias("role"), unescaped(body).alias("text")))


def turns(formatted: Column) -> Column:
    """All turns of a formatted conversation, parsed."""
    return F.transform(segments(formatted), parsed)


def formatted(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) for each conversation of ``rows`` (conv_id, turn, role, text)."""
    source = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("code", F.url_encode("role"))

    def same(body):
        back = turns(segment(F.col("code"), body))
        return (F.size(back) == 1) & F.coalesce(back[0].eqNullSafe(F.struct(F.col("role"), F.col("text"))), F.lit(False))

    # A first, cheap condition spares most turns the parser: with no control string and no backslash, the turn must come back as it is.
    simple = ~F.contains("text", F.lit("\\")) & ~F.regexp_like("text", F.lit(CONTROL))
    firm = F.raise_error(F.concat(F.lit("no round trip in conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    body = F.when(simple & same(F.col("text")), F.col("text")).when(same(escaped(F.col("text"))), escaped(F.col("text"))).otherwise(firm)
    made = source.withColumn("body", body).select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            "text",
            segment(F.col("code"), F.col("body")).alias("segment"),
            F.when(F.col("role") == ASSISTANT, F.length("body")).otherwise(0).alias("length"),
            (F.length(F.lit(START)) + F.length("code") + 1).alias("start"),
        ).alias("t"),
    )
    whole = made.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform("t", lambda t, k: F.struct(k.alias("turn"), t["start"].alias("start"), t["length"].alias("length")))
    source_turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    out = whole.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: t["segment"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        source_turns.alias("source_turns"),
    )
    identical = turns(F.col("formatted")).eqNullSafe(F.col("source_turns"))
    return out.select("conv_id", F.when(identical, F.col("formatted")).otherwise(firm).alias("formatted"), "loss_spans")


def loss_texts(text: Column, spans: Column) -> Column:
    """What lies under the loss mask, unescaped, one string for each turn (empty where none)."""
    return F.zip_with(segments(text), spans, lambda part, s: unescaped(F.substring(part, s["start"] + 1, s["length"])))


def digests(made: DataFrame) -> DataFrame:
    """The formatted conversations of ``formatted``, read back: counts and SHA-256 digests of turns and loss text."""
    read = made.select(
        "conv_id",
        turns(F.col("formatted")).alias("turns"),
        F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
