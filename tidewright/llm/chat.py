"""Chat formatting with typed content parts, with DataFrame functions only.

A turn holds an ordered array of parts (type, text, ref, size). A visitor over the parts writes text escaped, and every image, audio
or document part as a placeholder, in order; references and expanded token counts of the attachments are kept beside. Texts
can't forge a marker: ``\\``, ``<`` and ``[`` are escaped, reversibly, so neither this template's control strings nor ``</s>`` or
``[INST]`` of others stand in a formatted text unless the template wrote them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
PARTS = "array<struct<type:string,text:string,ref:string,size:double>>"
#: Placeholders, and the tokens that one unit of ``size`` expands to: image tiles, audio seconds, document pages.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
TOKENS_PER_UNIT = {"image": 256.0, "audio": 25.0, "document": 1024.0}
LOSS_ROLE = "assistant"
#: Characters of control strings and their escapes; the first is undone last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))


def escape(c: Column) -> Column:
    for plain, coded in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _by_type(kind: Column, values: dict, otherwise: Column) -> Column:
    out = None
    for name, value in values.items():
        out = (F if out is None else out).when(kind == name, F.lit(value))
    return out.otherwise(otherwise)


def visit(part: Column) -> Column:
    """What one part writes: text escaped, attachments as placeholders; a part of unknown type is text."""
    return _by_type(part["type"], PLACEHOLDER, escape(F.coalesce(part["text"], F.lit(""))))


def text_parts(text: Column) -> Column:
    """One text part; a null text is empty."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("size")))


def format_chat(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """One row per conversation from rows (conv_id, turn, role, parts).

    ``formatted`` is the text; ``loss`` has, for each turn of ``loss_role``, (turn, start, length): the code points of its content,
    counted from its turn marker; ``attachments`` has (position, turn, type, ref, tokens) in order of their placeholders, and
    ``attachment_tokens`` their sum. Null parts and roles are empty, a null size counts as one unit; a null turn comes last, rows of equal turn follow
    in order of role and content, and repeated rows each make a turn; null conversations are one conversation. Other columns are ignored. A conversation is one
    value, and so is one row in one task; nothing else is gathered.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), parts.alias("parts"))
    content = F.array_join(F.transform("parts", visit), "")
    attached = F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDER))
    tokens = lambda p: F.ceil(F.coalesce(p["size"], F.lit(1.0)) * _by_type(p["type"], TOKENS_PER_UNIT, F.lit(0.0)))
    held = F.transform(attached, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).cast("long").alias("tokens")))
    rows = rows.select("conv_id", F.struct(F.col("turn").isNull().alias("unnumbered"), "turn", "role", content.alias("content"), held.alias("held")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = lambda t: F.concat(F.lit(TURN), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    spans = F.transform("t", lambda t, i: F.struct(i.alias("turn"), F.length(head(t)).cast("long").alias("start"), F.length(t["content"]).cast("long").alias("length"), t["role"].alias("role")))
    spans = F.transform(F.filter(spans, lambda s: s["role"] == loss_role), lambda s: F.struct(s["turn"], s["start"], s["length"]))
    flat = F.flatten(F.transform("t", lambda t, i: F.transform(t["held"], lambda a: F.struct(i.alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: F.concat(head(t), t["content"], F.lit(END + "\n"))), "").alias("formatted"),
        spans.alias("loss"),
        F.transform(flat, lambda a, i: F.struct(i.alias("position"), a["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, x: s + x))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, losses): the turns (role, text) parsed from ``formatted``, and the texts under the mask ``loss``, unescaped."""
    segments = chats.select("conv_id", "loss", F.filter(F.split("formatted", r"<\|turn\|>"), lambda s: s != "").alias("s"))
    # a segment is role, newline, content, end marker, newline; newlines of a role are escaped
    content = lambda s: F.substr(s, F.instr(s, "\n") + 1, F.length(s) - F.instr(s, "\n") - len(END) - 1)
    turns = F.transform("s", lambda s: F.struct(unescape(F.replace(F.substring_index(s, "\n", 1), F.lit("\\n"), F.lit("\n"))).alias("role"), unescape(content(s)).alias("text")))
    masked = F.transform("loss", lambda m: unescape(F.substr(F.get("s", m["turn"]), (m["start"] - len(TURN) + 1).cast("int"), m["length"].cast("int"))))
    return segments.select("conv_id", turns.alias("turns"), masked.alias("losses"))


def digests(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 of what :func:`read_back` reads."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read_back(chats).select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(all_turns).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"))
