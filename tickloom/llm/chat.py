"""Chat formatting in budgeted, turn-aligned windows (DataFrame functions only).

Prefix sums of turn tokens cut each conversation into cells of ``span`` tokens. Turns that
lie inside one cell share a window; a turn that crosses a cell border has a window of its own. So
every window holds at most ``span`` new tokens unless a single turn is longer. The window
starts with the system turn, repeats the turns that end it within ``history`` tokens, and then
gives its new turns. Only new assistant turns are under the loss mask, so each is learnt once.

Template: ``<turn INDEX new|seen>ROLE\\nTEXT</turn>\\n``. ``\\`` becomes ``\\b`` and ``<`` becomes ``\\l``
inside roles and texts (line breaks in roles ``\\n``), so no text can hold a control string and the
escape is reversible.

Defined cases: null text is empty; null role is empty; turns are ordered by (turn with nulls last,
role, text), so ties and repeated rows have a fixed order and all stay; rows with null conv_id form
one conversation; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import table

SPAN, HISTORY = 384, 128
OPEN, CLOSE = "<turn ", "</turn>\n"
PROBE = r"\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Token estimate without a tokenizer: four per turn for the template and one per four characters."""
    return (F.ceil(F.length(text) / 4) + 4).cast("long")


def windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, formatted, loss): ``loss`` lists (start, length) in code points of ``formatted``."""
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", (F.row_number().over(order) - 1).alias("idx"), tokens(F.col("text")).alias("n"))
    rows = rows.withColumn("end", F.sum("n").over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, 0))).withColumn("before", F.col("end") - F.col("n"))
    first_cell, last_cell = F.expr(f"`before` div {span}"), F.expr(f"(`end` - 1) div {span}")
    rows = rows.withColumn("window", F.when(first_cell == last_cell, first_cell * 2).otherwise(first_cell * 2 + 1))
    turn = F.struct("idx", "role", "text")
    recent = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    at_start = Window.partitionBy("conv_id").orderBy("idx")
    rows = rows.select("conv_id", "window", "idx", "role", "text",
                       F.collect_list(turn).over(recent).alias("past"),
                       F.first(F.when(F.col("role") == "system", turn), ignorenulls=True)
                       .over(at_start.rowsBetween(Window.unboundedPreceding, 0)).alias("system"))
    per = rows.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(turn)).alias("new"),
        F.min_by(F.struct("past", "system"), "idx").alias("lead"))
    head = F.col("lead.system.idx")
    kept_system = F.when(head.isNotNull() & (head < F.get("new", F.lit(0))["idx"]), F.array("lead.system")).otherwise(
        F.array().cast("array<struct<idx:int,role:string,text:string>>"))
    past = F.sort_array(F.filter("lead.past", lambda t: ~F.coalesce(t["idx"] == head, F.lit(False))))
    seen = F.transform(F.concat(kept_system, past), lambda t: block(t, "seen"))
    per = per.select("conv_id", "window", F.concat(seen, F.transform("new", lambda t: block(t, "new"))).alias("blocks"))
    # offsets are running sums of block lengths inside one bounded window
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    walk = F.aggregate("blocks", zero, lambda acc, b: F.struct(
        (acc["at"] + F.length(b["s"])).alias("at"),
        F.when(b["learn"] > 0, F.concat(acc["loss"], F.array(F.struct(
            (acc["at"] + b["head"]).alias("start"), (b["learn"] - 1).cast("long").alias("length"))))).otherwise(acc["loss"]).alias("loss")))
    return per.select("conv_id", "window", F.array_join(F.transform("blocks", lambda b: b["s"]), "").alias("formatted"),
                      walk["loss"].alias("loss"))


def block(t: Column, mark: str) -> Column:
    """One formatted turn; ``learn`` is 1 + the text's length where it is a target, else 0."""
    role = F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\n"))
    head = F.concat(F.lit(OPEN), t["idx"].cast("string"), F.lit(f" {mark}>"), role, F.lit("\n"))
    body = escape(t["text"])
    learn = F.when((t["role"] == "assistant") & F.lit(mark == "new"), F.length(body) + 1).otherwise(F.lit(0))
    return F.struct(F.concat(head, body, F.lit(CLOSE)).alias("s"), F.length(head).cast("long").alias("head"), learn.alias("learn"))


def read_back(out: DataFrame) -> DataFrame:
    """Parse windows: (conv_id, turns [(idx, role, text)] without repeats, loss text, lengths), one row per conversation."""
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != "")
    head = r"(?s)^<turn (\d+) (new|seen)>([^\n]*)\n(.*)$"
    parsed = F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, head, 1).cast("int").alias("idx"), F.regexp_extract(b, head, 2).alias("mark"),
        unescape(F.replace(F.regexp_extract(b, head, 3), F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(F.regexp_extract(b, head, 4)).alias("text")))
    fresh = F.transform(F.filter(parsed, lambda t: t["mark"] == "new"), lambda t: F.struct(t["idx"], t["role"], t["text"]))
    learnt = F.transform("loss", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int"))))
    one = out.select("conv_id", "window", fresh.alias("turns"), F.array_join(learnt, "").alias("learnt"),
                     F.length("formatted").cast("long").alias("chars"))
    return one.groupBy("conv_id").agg(
        F.sort_array(F.flatten(F.collect_list("turns"))).alias("turns"),
        F.sort_array(F.collect_list(F.struct("window", "learnt"))).alias("learnt"),
        F.sum("chars").alias("formatted_chars")).withColumn(
        "loss_text", F.array_join(F.transform("learnt", lambda w: w["learnt"]), ""))


def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    read = read_back(windows(turns.unionByName(probe)))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars")


QUERIES = {"op9_chat_format": (op9, None)}
