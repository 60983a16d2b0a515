"""Chat formatting by grammar round trip, in DataFrame functions only.

Grammar of a rendered conversation:  turn*, turn = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n".
A text that holds a control string or a backslash is escaped: backslashes double, and backslash-tilde goes after the first character
of each control string, so that none is left whole. A role also has its newlines written as backslash-percent. The
deterministic parser splits at the end marks and at the first newline of a turn. ``format_chat`` first renders a turn as
it is and reparses it; where it does not come back identical, or holds a control string, it is escaped. The whole
conversation is reparsed in the end and compared to its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<\|[A-Za-z0-9_]+\|>|</?s>|<</?SYS>>|\[/?[A-Z_]{2,}\]"
_FIRST = r"([<\[])(?=\|[A-Za-z0-9_]+\|>|/?s>|</?SYS>>|/?[A-Z_]{2,}\])"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _FIRST, r"$1\\~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|~)", "$1")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), "\n", r"\\%")


def _unescape_role(role: Column) -> Column:
    # a newline mark has an odd number of backslashes before the percent sign
    marked = F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\%", "$1\n")
    return unescape(marked)


def parse(rendered: Column) -> Column:
    """array<struct<role,text>> that the grammar reads from a rendered conversation, still escaped."""
    turns = F.filter(F.split(rendered, r"<\|im_end\|>\n"), lambda t: t != "")
    body = lambda t: F.substr(t, F.lit(len(START) + 1))
    role = lambda t: F.substring_index(body(t), "\n", 1)
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), F.substr(body(t), F.length(role(t)) + 2).alias("text")))


def _read(rendered: Column) -> Column:
    return F.transform(parse(rendered), lambda x: F.struct(_unescape_role(x["role"]).alias("role"), unescape(x["text"]).alias("text")))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, rendered, loss_spans (start and length of each assistant text in
    ``rendered``, from 0), escaped (whether a turn had to be escaped), intact (whether ``rendered``, reparsed, equals its source).

    ``turns`` has conv_id, turn, role, text. Null role or text is empty; a row with a null conv_id is a conversation of its own;
    null turns come first; rows tied in turn are ordered by role, then text; repeated rows are repeated turns. An empty
    table gives none. A conversation is one string, so its turns meet in one task: that is the output's own size, as is a long text's.
    Other columns are ignored. A turn is rendered as it is, reparsed, and escaped where it does not come back identical;
    escaped turns always do, so ``intact`` is there to be asserted on.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    raw = _read(F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n")))
    conflict = (raw != F.array(F.struct("role", "text"))) | F.col("text").rlike(CONTROL) | F.col("role").rlike(CONTROL)
    shown_role = F.when(conflict, _escape_role(F.col("role"))).otherwise(F.col("role"))
    shown_text = F.when(conflict, escape(F.col("text"))).otherwise(F.col("text"))
    piece = F.concat(F.lit(START), "shown_role", F.lit("\n"), "shown_text", F.lit(END + "\n"))
    rows = rows.withColumns({"escaped": conflict, "shown_role": shown_role, "shown_text": shown_text})
    rows = rows.withColumns({"piece": piece, "lead": F.length("shown_role") + F.lit(len(START) + 1), "size": F.length("shown_text")})
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    turn = F.struct("ord", "role", "text", "piece", "at", "size", "escaped")
    many = rows.filter("conv_id is not null").withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("lead"))
    many = many.withColumn("ord", F.row_number().over(order)).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    lone = rows.filter("conv_id is null").withColumns({"at": F.col("lead").cast("long"), "ord": F.lit(1)})
    convs = many.unionByName(lone.select("conv_id", F.array(turn).alias("t")))
    convs = convs.withColumn("rendered", F.array_join(F.transform("t", lambda x: x["piece"]), ""))
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    spans = F.transform(F.filter("t", lambda x: x["role"] == "assistant"), lambda x: F.struct(x["at"].cast("long").alias("start"), x["size"].cast("long").alias("length")))
    return convs.select("conv_id", "rendered", spans.alias("loss_spans"), F.exists("t", lambda x: x["escaped"]).alias("escaped"), (_read(F.col("rendered")) == source).alias("intact"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what the rendered text says: turns by the parser, loss text by the spans of the loss mask; and intact."""
    read = formatted.withColumn("turns", parse(F.col("rendered")))
    turns = F.transform("turns", lambda x: F.concat(_unescape_role(x["role"]), F.lit("\n"), unescape(x["text"]), F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("rendered"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = read.withColumns({"turns_text": F.array_join(turns, ""), "loss_text": F.array_join(masked, "")})
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("rendered").cast("long").alias("formatted_chars"), "intact",
    )
