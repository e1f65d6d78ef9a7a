"""Chat formatting of typed content parts, with DataFrame functions only.

A visitor walks the parts of each turn: text is escaped and copied, image, audio
and document parts become numbered placeholders whose references and expanded
token counts are recorded. The template is

    <|turn|>ROLE<|text|>CONTENT<|end|>

for each turn. Inside roles and texts every control string is escaped, so that
``read_chat`` gets the turns back from the formatted string alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not stand in a text, and what is written instead; the order matters.
ESCAPES = (("\\", "\\e"), ("<|", "\\l|"), ("</s>", "\\l/s>"), ("[INST]", "\\iINST]"), ("[/INST]", "\\i/INST]"))
UNESCAPES = (("\\l", "<"), ("\\i", "["), ("\\e", "\\"))
ATTACHMENTS = {"image": 256.0, "audio": 25.0, "document": 600.0}
PART = "struct<type:string,text:string,ref:string,units:double>"


def escape(text: Column) -> Column:
    for found, written in ESCAPES:
        text = F.replace(text, F.lit(found), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for found, written in UNESCAPES:
        text = F.replace(text, F.lit(found), F.lit(written))
    return text


def text_part(text: Column) -> Column:
    """Content of one text part; a null text is an empty one."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def _before(order: str | list[str]) -> WindowSpec:
    """The rows of a conversation that come before a row."""
    return Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _joined(pieces: Column, name: str) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p[name]), "")


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", rates: dict[str, float] | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens.

    parts_col holds ``array<struct<type,text,ref,units>>``. Rows are ordered by
    turn (null first), equal turns by role and content; repeated rows are turns
    of their own. Null roles, texts and part lists are empty ones; parts of an
    unknown type are read as text. All rows of a null conv_id are one
    conversation. loss_spans are [start, length] in code points, from 0, of the
    content of turns of loss_role. An empty table gives no rows. A conversation
    is one output row, so it must fit in a task, as any Spark row must; the time
    it takes grows with its turns and parts, but for their sorting: numbers and
    places are running sums over rows that stay where the conversation was gathered.
    """
    rates = rates or ATTACHMENTS
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(parts_col).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")).alias("parts"),
        ).alias("t"),
    )
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = conv.select("conv_id", F.posexplode("turns").alias("i", "t")).select("conv_id", "i", F.col("t.role").alias("role"), F.posexplode_outer("t.parts").alias("j", "part"))

    attached = F.coalesce(F.col("part.type").isin(*rates), F.lit(False))
    parts = parts.withColumn("number", F.coalesce(F.sum(attached.cast("long")).over(_before(["i", "j"])), F.lit(0).cast("long")))
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("part.type"))
    tokens = F.ceil(F.greatest(F.coalesce("part.units", F.lit(1.0)), F.lit(0.0)) * rate).cast("long")
    placeholder = F.concat(F.lit("<|"), F.col("part.type"), F.lit(":"), F.col("number").cast("string"), F.lit("|>"))
    written = F.when(attached, placeholder).otherwise(escape(F.coalesce("part.text", F.lit(""))))
    said = parts.groupBy("conv_id", "i").agg(
        F.first("role").alias("role"),
        _joined(F.sort_array(F.collect_list(F.struct("j", written.alias("w")))), "w").alias("body"),
        F.sort_array(F.collect_list(F.when(attached, F.struct(F.col("number").cast("int").alias("number"), "part.type", "part.ref", tokens.alias("tokens"))))).alias("attachments"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    said = said.select("conv_id", "i", "role", "attachments", F.length(head).cast("long").alias("skip"), F.length("body").cast("long").alias("length"), F.concat(head, F.col("body"), F.lit(END)).alias("piece"))
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(_before("i")), F.lit(0).cast("long")) + F.col("skip")
    span = F.when(F.col("role") == loss_role, F.struct("start", "length"))
    chats = said.withColumn("start", start).groupBy("conv_id").agg(
        _joined(F.sort_array(F.collect_list(F.struct("i", "piece"))), "piece").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
        F.sort_array(F.flatten(F.collect_list("attachments"))).alias("attachments"),
    )
    return chats.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_chat(chats: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, placeholders left out), loss_text and formatted_chars, read back from formatted and loss_spans.

    formatted falls into pieces, one for each turn, whose places are the running
    sum of the lengths before them; a span is read from the last piece that does
    not begin after it, so that no span is sought from the start of the string.
    A row of chats is one conversation; a span lies within a turn.
    """
    quoted = lambda s: s.replace("|", r"\|")
    holder = r"<\|[a-z]+:\d+\|>"
    pieces = F.filter(F.split("formatted", quoted(END)), lambda p: F.startswith(p, F.lit(TURN)))
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("long")
    marks = F.concat(
        F.transform(pieces, lambda p: F.struct(p.alias("piece"), no_number.alias("start"), no_number.alias("length"))),
        F.transform("loss_spans", lambda s: F.struct(no_text.alias("piece"), s["start"].cast("long").alias("start"), s["length"].cast("long").alias("length"))),
    )
    sized = chats.withColumn("formatted_chars", F.length("formatted").cast("long"))  # once for each conversation, not for each mark
    rows = sized.select("conv_id", "formatted_chars", F.posexplode_outer(marks).alias("k", "m")).select("conv_id", "formatted_chars", "k", "m.*")
    held = F.sum(F.length("piece").cast("long") + len(END)).over(_before("k"))
    rows = rows.withColumn("at", F.coalesce("start", held, F.lit(0).cast("long")))
    under = Window.partitionBy("conv_id").orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("under", F.last(F.when(F.col("piece").isNotNull(), F.struct("at", "piece")), ignorenulls=True).over(under))

    role = F.substring_index(F.substring("piece", len(TURN) + 1, 2**31 - 1), TEXT, 1)
    body = F.substring("piece", F.length(role) + len(TURN) + len(TEXT) + 1, F.length("piece"))
    text = lambda c: unescape(F.regexp_replace(c, holder, ""))
    loss = text(F.substring(F.col("under.piece"), (F.col("start") - F.col("under.at") + 1).cast("int"), F.col("length").cast("int")))
    read = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("k", unescape(role).alias("role"), text(body).alias("text"))))).alias("turns"),
        _joined(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("k", loss.alias("loss"))))), "loss").alias("loss_text"),
        F.first("formatted_chars").alias("formatted_chars"),
    )
    return read.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), "loss_text", "formatted_chars")


def chat_digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted chats."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_chat(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
