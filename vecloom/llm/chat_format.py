r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Template, per turn: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts ``\`` is written ``\\`` and ``<|`` is written
``<\|``, so no text can hold a control string, and undoing the escapes gives the text back.

``format_chats`` writes every turn once, as a piece of its conversation's text, with its place in that text by a running sum of
lengths. ``examples`` explodes every assistant turn into an example of its own: its context is the text of all that precedes the reply,
its target is the reply, and only the target is trainable. ``read_back`` puts conversations together again from these examples.

Contexts are prefixes of one text, so all of them have as many characters as the square of a conversation's length. They are cut by bytes
(no walk over characters), one row at a time where the conversation already is: no exchange, sort or spill holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import documents

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_chats(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """One row per turn: (conv_id, alone, position from 0, begin, target_start, target_end, trainable, last, since, octets, piece).

    ``begin`` is where the piece starts in the conversation's text, the target span is that of the turn's text in it; code points from
    0, ends exclusive. In bytes, ``octets`` is where the piece starts and ``since`` where the last assistant turn before it ends (0: none).
    Turns are in the order of ``turn`` (null first), ties by role, then text; repeated rows stay. Null roles and texts are empty. A row
    without conv_id belongs to no known conversation and is one by itself (``alone``). Other columns are not read.
    """
    rows = df.select(F.col(conv_id).alias(conv_id), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    head, body = F.concat(F.lit(TURN), escape(F.col("r")), F.lit(TEXT)), F.concat(escape(F.col("x")), F.lit(END))
    piece, trainable = F.concat(head, body), F.col("r") == target
    order = Window.partitionBy(conv_id).orderBy(F.asc_nulls_first("t"), "r", "x")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda size: F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0))
    known = rows.where(F.col(conv_id).isNotNull()).withColumns({
        "position": F.row_number().over(order) - 1, "begin": total(F.length(piece)), "octets": total(F.octet_length(piece)), "last": F.lead(F.lit(1)).over(order).isNull(), "alone": F.lit(False)})
    known = known.withColumn("since", F.coalesce(F.max(F.when(trainable, F.col("octets") + F.octet_length(piece))).over(before), F.lit(0)))
    zero = F.lit(0).cast("long")
    lost = rows.where(F.col(conv_id).isNull()).withColumns({"position": F.lit(0), "begin": zero, "octets": zero, "last": F.lit(True), "alone": F.lit(True), "since": zero})
    start = F.col("begin") + F.length(head)
    # pieces are made here, so that the exchange carries each text once
    return known.unionByName(lost).select(
        conv_id, "alone", "position", "begin", start.alias("target_start"), (start + F.length(body) - len(END)).alias("target_end"), trainable.alias("trainable"), "last", "since", "octets", piece.alias("piece"))


def _replies() -> Column:
    """What is exploded into an example: an assistant turn's place, in bytes where its context and its target end; null for other turns.
    A last turn that isn't a reply has a place too, so that what follows the last reply isn't lost: its context is all, without target."""
    head = F.octet_length(F.substring("piece", F.lit(1), (F.col("target_start") - F.col("begin")).cast("int")))
    end = F.col("octets") + F.octet_length("piece")
    place = F.struct("position", "trainable", "since", F.when(F.col("trainable"), F.col("octets") + head).otherwise(end).cast("int").alias("context_octets"), (end - len(END)).cast("int").alias("target_octets"), "target_start", "target_end")
    return F.when(F.col("trainable") | F.col("last"), place)


def _whole(turns: DataFrame, conv_id: str) -> tuple[DataFrame, DataFrame]:
    """One row per conversation, of those with a conv_id and of those without: (conv_id, formatted, replies)."""
    listed = lambda c: F.array_sort(F.collect_list(c))
    known = turns.where("NOT alone").groupBy(conv_id).agg(listed(F.struct("position", "piece")).alias("p"), listed(_replies()).alias("replies"))
    known = known.select(conv_id, F.array_join(F.transform("p", lambda p: p["piece"]), "").alias("formatted"), "replies")
    return known, turns.where("alone").select(conv_id, F.col("piece").alias("formatted"), F.array(_replies()).alias("replies"))


def _exploded(whole: DataFrame, conv_id: str) -> DataFrame:
    """A row per reply, with its context written out, and one for the turns after the last reply, whose target is null."""
    rows = whole.select(conv_id, F.col("formatted").cast("binary").alias("b"), F.inline_outer("replies"))
    target = F.substring("b", F.col("context_octets") + 1, F.col("target_octets") - F.col("context_octets"))
    return rows.select(
        conv_id, "position", "trainable", "since", "target_start", "target_end",
        F.substring("b", F.lit(1), F.col("context_octets")).cast("string").alias("context"), F.when(F.col("trainable"), target.cast("string")).alias("target"))


def examples(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per assistant turn: (conv_id, alone, position, context_end, target_start, target_end, context, target), texts still escaped.

    The context is all of the conversation's text up to ``context_end``, the head of the reply's own turn included.
    """
    known, alone = (_exploded(whole, conv_id).where("trainable") for whole in _whole(turns, conv_id))
    found = known.withColumn("alone", F.lit(False)).unionByName(alone.withColumn("alone", F.lit(True)))
    return found.select(conv_id, "alone", "position", F.col("target_start").alias("context_end"), "target_start", "target_end", "context", "target")


def conversations(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row per conversation: (conv_id, formatted), the pieces one after the other; a conversation has to fit a row."""
    known, alone = _whole(turns, conv_id)
    return known.unionByName(alone).select(conv_id, "formatted")


def with_context(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, position, context, target), still escaped."""
    return examples(turns, conv_id).select(conv_id, "position", "context", "target")


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn of a formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, TEXT, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, TEXT, -1), END, 1)).alias("text")))


def read_back(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, turns array of (role, text), targets array of string), one row per conversation, all from its exploded rows:
    each gives what its context has beyond the example before it, and its target. They meet where they were exploded, without an exchange."""
    known, alone = (_exploded(whole, conv_id) for whole in _whole(turns, conv_id))
    own = F.substring(F.col("context").cast("binary"), (F.col("since") + 1).cast("int"), F.octet_length("context")).cast("string")
    own = F.concat(own, F.when(F.col("trainable"), F.concat("target", F.lit(END))).otherwise(""))
    known = known.select(conv_id, "position", own.alias("own"), "target").groupBy(conv_id).agg(F.array_sort(F.collect_list(F.struct("position", "own", "target"))).alias("e"))
    alone = alone.select(conv_id, F.array(F.struct("position", own.alias("own"), "target")).alias("e"))
    found = known.unionByName(alone).select(
        conv_id, F.array_join(F.transform("e", lambda e: e["own"]), "").alias("formatted"),
        F.transform(F.filter("e", lambda e: e["target"].isNotNull()), lambda e: unescape(e["target"])).alias("targets"))
    return found.select(conv_id, "formatted", read_turns(F.col("formatted")).alias("turns"), "targets")


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    chats = read_back(format_chats(table.unionByName(planted)))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length(F.array_join("targets", "")).cast("long").alias("loss_chars"), F.sha2(F.array_join("targets", ""), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE_SQL = r"""
WITH a AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lost, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
           UNION ALL VALUES (-7, NULL, 0, 'user', '\### Assistant: </turn> ok'), (-7, NULL, 1, 'assistant', '\### Assistant: </turn> ok')),
     b AS (SELECT *, length(replace(replace(r, '\', '\\'), '<|', '<\|')) + length(replace(replace(x, '\', '\\'), '<|', '<\|')) + 23 AS n FROM a)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
       length(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM b GROUP BY conv_id, lost
"""
