r"""Chat formatting of conversations made of typed content parts, with a loss mask that can be read back.

A turn is ``<|im_start|>role<|im_sep|>content<|im_end|>`` and a line end. Content parts are visited in order: a text
part stands as it is, an image, audio or document part becomes a placeholder with its number in the conversation's
turn, and its reference and expanded number of tokens are recorded. Inside roles and texts ``\`` becomes ``\\`` and
``<|`` becomes ``<\|``, so no text can write a control string, and taking the first character off every pair that a
backslash begins gives the text back.

Everything is DataFrame functions. Starts of turns are running sums over the conversation, so time is linear in its
length; a conversation is one row of the result, however, and has to fit a task.

Null roles, texts and unknown part types count as empty text. Turns are ordered by turn (null first), equal ones by
role and content. Repeated rows are repeated turns. Rows with a null ``conv_id`` are one conversation. An empty table
gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"
PARTS = "array<struct<type: string, text: string, ref: string, units: int>>"
#: Tokens that a unit stands for: an image tile, a second of audio, a page of a document.
EXPANDED = {"image": 256, "audio": 25, "document": 800}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column, number: Column) -> Column:
    """What a part puts into the content."""
    placeholder = F.concat(F.lit("<|"), part["type"], F.lit(":"), number.cast("string"), F.lit("|>"))
    return F.when(part["type"].isin(*EXPANDED), placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def attachment(part: Column, number: Column) -> Column:
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in EXPANDED.items() for x in kv]), part["type"])
    tokens = (rate * F.coalesce(part["units"], F.lit(1))).cast("long")
    return F.struct(part["type"].alias("type"), number.alias("number"), part["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A turn that is plain text."""
    return F.array(F.struct(F.lit("text"), text, F.lit(None), F.lit(None))).cast(PARTS)


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to conv_id, n_turns, formatted, mask, attachments.

    ``mask`` has the learned stretches in order: turn number, start in the turn's own string, start in ``formatted``
    and length, in characters. ``attachments`` has turn number, type, number, ref and tokens.
    """
    content = F.concat_ws("", F.transform("parts", visit))
    # Filtering keeps a part's number, which its placeholder has, too.
    attached = F.filter(F.transform("parts", attachment), lambda a: a["type"].isin(*EXPANDED))
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("content"), attached.alias("attached")
    )
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR))
    rows = rows.withColumn("piece", F.concat(head, F.col("content"), F.lit(END))).withColumn("head", F.length(head))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order) - 1).withColumn(
        "start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0))
    )
    learned = F.when(F.col("role") == LEARNED, F.struct(
        "n", F.col("head").alias("within"), (F.col("start") + F.col("head")).alias("start"), F.length("content").alias("length")
    ))
    out = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("n", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(learned)).alias("mask"),
        F.array_sort(F.collect_list(F.struct("n", "attached"))).alias("attached"),
    )
    flat = F.flatten(F.transform("attached", lambda t: F.transform(t["attached"], lambda a: F.struct(
        t["n"].alias("n"), a["type"].alias("type"), a["number"].alias("number"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
    ))))
    return out.select("conv_id", "n_turns", F.concat_ws("", "pieces.piece").alias("formatted"), "mask", flat.alias("attachments"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text; placeholders stay) and ``loss_text``, both from ``formatted`` and ``mask`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), F.lit(2), F.greatest(F.lit(0), F.col("n_turns").cast("int")))

    def turn(piece: Column) -> Column:
        halves = F.split(piece, r"<\|im_sep\|>", 2)
        text = F.substring(halves[1], F.lit(1), F.length(halves[1]) - len(END))
        return F.struct(unescape(halves[0]).alias("role"), unescape(text).alias("text"))

    rows = formatted.withColumn("_pieces", pieces)
    learned = F.transform(
        "mask",
        lambda m: unescape(F.substring(F.concat(F.lit(START), F.get("_pieces", m["n"])), m["within"] + 1, m["length"])),
    )
    return rows.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss_text", F.concat_ws("", learned)).drop("_pieces")


def digest_chats(read: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
