"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and the
loss covers that reply's text alone.  Turns after the last assistant turn (or a conversation
without one) make one closing example without loss, so the output holds every turn.

A turn is written ``### role: text</turn>`` and a line feed.  In texts and roles ``\\`` is
written ``\\\\``, ``#`` is written ``\\#`` and ``</turn>`` is written ``<\\/turn>``; in roles ``:`` is
written ``\\=`` too.  So the marks never occur in an escaped text, the first ``:`` of a turn ends
its role, and cutting at double backslashes, then dropping the single ones, gives the text back.

Defined results: null role or text is empty; rows with a null conv_id are one conversation; turns
that tie are ordered by role, then text; repeated rows are repeated turns; extra columns are
ignored, whatever their names; roles and texts may have any length; an empty table gives no examples.  One conversation is one row while it is formatted,
for its examples are its prefixes; the output of a conversation of n turns grows as n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, COLON, END = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("#"), F.lit("\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    """Without a pattern that backtracks: a run of backslashes is doubled ones, then at most one single."""
    plain = lambda p: F.replace(F.replace(p, F.lit("\\="), F.lit(":")), F.lit("\\"), F.lit(""))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_examples(conversations: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 1), text, loss_start, loss_end (code points, half open), closing.

    ``closing`` marks the one example of a conversation that holds all its turns.
    """
    turns = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(HEAD), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\=")), F.lit(COLON))
    parts = grouped.select(
        "conv_id",
        F.transform("ts", lambda t: F.concat(head(t), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("ts", lambda t: F.struct((t["role"] == trainable_role).alias("trainable"), F.length(head(t)).alias("head"), F.length(escape(t["text"])).alias("body"))).alias("sizes"),
    )
    n = F.size("parts")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("sizes", i)["trainable"] | (i == n))
    exploded = parts.select("conv_id", "parts", "sizes", n.alias("n"), F.posexplode(targets).alias("at", "i"))
    last = F.element_at("sizes", F.col("i"))
    text = F.array_join(F.slice("parts", 1, F.col("i")), "")
    out = exploded.select("conv_id", (F.col("at") + 1).alias("example"), text.alias("text"), (F.col("i") == F.col("n")).alias("closing"), last["trainable"].alias("_t"), last["body"].alias("_b"))
    end = F.length("text") - len(END)
    return out.select("conv_id", "example", "text", F.when(F.col("_t"), end - F.col("_b")).alias("loss_start"), F.when(F.col("_t"), end).alias("loss_end"), "closing")


def parse(text: Column) -> Column:
    """The turns of a formatted text: array of struct(role, text)."""
    parts = F.split(text, "</turn>\n")
    turn = lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(HEAD) + 1, 1 << 30), COLON, 1)).alias("role"),
        unescape(F.substring(p, F.locate(COLON, p) + len(COLON), F.lit(1 << 30))).alias("text"),
    )
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from formatted examples: n_turns, turns_sha256, loss_chars,
    loss_sha256 and formatted_chars (of all its examples)."""
    whole = F.when(F.col("closing"), parse(F.col("text")))
    rows = examples.select(
        "conv_id",
        "example",
        F.length("text").cast("long").alias("chars"),
        F.size(whole).alias("turns"),
        F.when(F.col("closing"), F.sha2(F.array_join(F.transform(whole, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("sha"),
        F.when(F.col("loss_start").isNotNull(), unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))).alias("reply"),
    )
    grouped = rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("sha").isNotNull(), F.col("turns"))).cast("long").alias("n_turns"),
        F.max("sha").alias("turns_sha256"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))), lambda x: x["reply"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
