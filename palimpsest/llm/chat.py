"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a role and an array of parts. A visitor over the parts writes text parts as they are and
flattens image, audio and document parts into placeholders <|image:turn.part|>, whose references and
expanded token counts are recorded beside. A conversation is written as

    <|turn|>role LF body </s> LF    for each turn

Inside texts and roles a backslash parts every control string (and each backslash is doubled), so
no text can end a turn or begin one, and reading takes each backslash away and keeps what follows.
The loss mask lists the code points of assistant bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BEGIN, END = "<|turn|>", "</s>\n"
#: Tokens that a part takes when it is expanded: for each tile of an image, second of audio and page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 768}
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    """The text without control strings; ``unescape`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, r"<(?=\||/?s>|/?<?/?SYS>>)", r"<\\"), r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _placeholder(part: Column, index: Column, turn: Column) -> Column:
    return F.concat(F.lit("<|"), part["type"], F.lit(":"), F.coalesce(turn.cast("string"), F.lit("-")), F.lit("."), index.cast("string"), F.lit("|>"))


def _body(parts: Column, turn: Column) -> Column:
    """The parts of a turn, visited in order: texts between placeholders are joined and then escaped, as parts may make a control string together."""
    placed = F.filter(F.transform(parts, lambda p, i: F.when(p["type"].isin(*TOKENS), i)), lambda i: i.isNotNull())

    def run(at: Column, k: Column) -> Column:
        start, end = F.when(k == 0, F.lit(0)).otherwise(F.get(at, k - 1) + 1), F.coalesce(F.get(at, k), F.size(parts))
        text = F.array_join(F.transform(F.slice(parts, start + 1, end - start), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        return F.concat(escape(text), F.coalesce(_placeholder(F.get(parts, end), end, turn), F.lit("")))

    # transform over an array of one binds a name, so that the places are found once
    return F.transform(F.array(placed), lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), lambda k: run(at, k)), ""))[0]


def _attachments(parts: Column, turn: Column) -> Column:
    found = F.filter(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: x["p"]["type"].isin(*TOKENS))
    per = lambda kind: F.coalesce(*(F.when(kind == k, F.lit(n)) for k, n in TOKENS.items()))
    return F.transform(found, lambda x: F.struct(turn.alias("turn"), x["i"].alias("part"), x["p"]["type"].alias("type"), x["p"]["ref"].alias("ref"), F.ceil(F.greatest(F.coalesce(x["p"]["units"], F.lit(1.0)), F.lit(0.0)) * per(x["p"]["type"])).alias("tokens")))


def as_parts(text: Column) -> Column:
    """A text as the only part of a turn; null is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))


def format_chats(turns: DataFrame) -> DataFrame:
    """Of turns (conv_id, turn, role, parts): conv_id, n_turns, formatted, loss_mask, attachments, for each conversation.

    ``loss_mask`` holds start and length, in code points of ``formatted``, of each assistant body, in order;
    ``attachments`` holds turn, part, type, ref and tokens of each part that isn't text. Turns
    are ordered by turn (null first), then role and body; repeated rows are turns of their own. A null role is
    empty, null parts are none, a part of an unknown type is text. Rows with a null conv_id make one conversation.
    Other columns are not read.
    """
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("parts"), F.expr(f"cast(array() as {PARTS})")).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", _body(F.col("parts"), F.col("turn")).alias("body"), _attachments(F.col("parts"), F.col("turn")).alias("attachments"))
    rows = rows.withColumn("head", F.concat(F.lit(BEGIN), _role(F.col("role")), F.lit("\n"))).withColumn("piece", F.concat("head", "body", F.lit(END)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    rows = rows.withColumn("no", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("before") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "piece", span.alias("span"), "attachments"))).alias("turns"))
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_mask"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds; attachments stay placeholders."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    role = lambda p: F.replace(F.replace(unescape(F.substring_index(p, "\n", 1)), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))
    body = lambda p: F.substring(p, F.instr(p, "\n") + F.lit(1), F.length(p) - F.instr(p, "\n") - F.lit(len(END)))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text")))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """Per conversation, read back from ``formatted`` and ``loss_mask``: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = chats.select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
