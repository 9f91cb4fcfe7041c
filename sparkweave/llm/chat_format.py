"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are laid end to end by prefix sums of their token counts (words plus MARKUP); a window
takes the turns that start in one stride of that line, so windows are turn-aligned and every turn is new in exactly
one. A window opens with the conversation's system turn (if it is not in it anyway) and with as much of the turns
just before as fits `history` tokens; both are repeated and masked. Only assistant turns that are new bear loss, as
spans of the formatted text. Prefix sums are taken in blocks of BLOCK_TURNS turns and then over blocks, and windows
are keyed by (conversation, stride), so a conversation that holds a large share of all rows is spread over tasks.

Template of a turn: "### ", role, ": ", text, " </turn>", newline. In roles and texts a backslash, #, < and (in
roles) a colon are written as a backslash and b, h, l or c, so control strings cannot occur in them and the escape
can be undone one letter at a time.

Edge cases: null roles and texts are empty. Turns are ordered by turn (nulls last), then role, then text; repeated
rows are turns of their own. A null conv_id is one conversation. A turn over a stride stands in a window that may
exceed the budget (`n_tokens` says so) and is never cut. A table without rows gives no rows. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 128
MARKUP = 4
BLOCK_TURNS = 256
TURN_END = " </turn>\n"
#: Stands for a null conv_id while rows are joined.
_NULL = -(2**63)
_LAST = 2**63 - 1
_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(c: Column, role: bool = False) -> Column:
    for raw, code in (*_CODES, *([(":", "\\c")] if role else [])):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for raw, code in ((":", "\\c"), *reversed(_CODES)):
        c = F.replace(c, F.lit(code), F.lit(raw))
    return c


def _turn(t: Column) -> Column:
    return F.concat(F.lit("### "), escape(t["role"], True), F.lit(": "), escape(t["text"]), F.lit(TURN_END))


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, n_tokens, n_turns (in it), n_repeated (leading turns that are masked),
    formatted, loss_spans (array of begin and end, code points of formatted)."""
    stride = (budget - history) // 2
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NULL)).alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(MARKUP))
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    blocks = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    turns = rows.withColumn("within", F.coalesce(F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turns = turns.join(blocks, ["conv", "block"])
    turns = turns.withColumn("start", F.col("base") + F.col("within")).withColumn("window", F.floor(F.col("start") / stride))
    own = turns.groupBy("conv", "window").agg(F.sort_array(F.collect_list(F.struct("start", "tokens", "role", "text"))).alias("new"))
    end = F.element_at("new", -1)["start"] + F.element_at("new", -1)["tokens"]
    tail = own.filter(F.floor(end / stride) > F.col("window")).select("conv", F.floor(end / stride).alias("window"), F.filter("new", lambda t: t["start"] >= end - history).alias("old"))
    systems = turns.filter((F.col("start") == 0) & (F.col("role") == "system")).select("conv", F.struct("start", "tokens", "role", "text").alias("system"))
    out = own.join(tail, ["conv", "window"], "left").join(systems, "conv", "left")
    old = F.coalesce("old", F.array().cast(own.schema["new"].dataType))
    here = F.exists(F.concat(old, F.col("new")), lambda t: t["start"] == 0)
    head = F.when(F.col("system").isNotNull() & ~here, F.array("system")).otherwise(F.array().cast(own.schema["new"].dataType))
    out = out.withColumn("repeated", F.concat(head, old)).withColumn("all", F.concat("repeated", "new"))
    out = out.withColumn("pieces", F.transform("all", _turn))
    lengths = F.transform("pieces", lambda p: F.length(p))
    out = out.withColumn("ends", F.transform(F.sequence(F.lit(1), F.size("pieces")), lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, x: a + x)))
    spans = F.transform(
        F.sequence(F.lit(1), F.size("all")),
        lambda i: F.struct(
            (F.element_at("ends", i) - F.length(F.lit(TURN_END)) - F.length(escape(F.element_at("all", i)["text"]))).alias("begin"),
            (F.element_at("ends", i) - F.length(F.lit(TURN_END))).alias("end"),
            ((i > F.size("repeated")) & (F.element_at("all", i)["role"] == "assistant")).alias("loss"),
        ),
    )
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))
    return out.select(
        F.when(F.col("conv") != _NULL, F.col("conv")).alias("conv_id"),
        "window",
        F.aggregate("all", F.lit(0), lambda a, t: a + t["tokens"].cast("int")).alias("n_tokens"),
        F.size("all").alias("n_turns"),
        F.size("repeated").alias("n_repeated"),
        F.array_join("pieces", "").alias("formatted"),
        spans.alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of role and text of a formatted window."""
    parts = F.split(formatted, TURN_END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(5)), ": ", 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, F.length(role) + F.lit(7))).alias("text"))

    return F.transform(parts, turn)


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    windows = chat_windows(conversations)
    turns = parse_turns(F.col("formatted"))
    new = F.slice(turns, F.col("n_repeated") + 1, F.col("n_turns"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["begin"] + 1, s["end"] - s["begin"])))
    read = windows.select(
        "conv_id",
        "window",
        F.length("formatted").alias("chars"),
        F.size(new).alias("n"),
        F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join(loss, "").alias("loss"),
    )
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("n").cast("long").alias("n_turns"), F.sum(F.length("loss")).cast("long").alias("loss_chars"), F.sum("chars").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.encode(F.array_join(F.col("w")[c], ""), "UTF-8"), 256)
    return whole.select("conv_id", "n_turns", sha("turns").alias("turns_sha256"), "loss_chars", sha("loss").alias("loss_sha256"), "formatted_chars")


def hostile(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts look like the template."""
    text = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
