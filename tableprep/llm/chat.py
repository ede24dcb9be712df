"""Operator 9 - chat formatting in budgeted windows.

Prefix sums of the turns' tokens (words) cut a conversation into turn-aligned spans: a span holds the turns whose
prefix sum starts in the same half of the span budget, and a turn above that half is a span of its own, so a span stays
within the budget unless a single turn exceeds it. Every window shows the conversation's system turn first, then at
most ``history_turns`` earlier turns within ``history_tokens`` (repeats), then its span. The loss mask covers the
assistant turns of the span only, so each assistant text is under it exactly once.

Template of a turn: ``[role]text</s>``. Inside texts and roles ``\\ < [ ]`` are written ``\\b \\l \\o \\c``, so no control
string can occur there and reading back is exact.

DataFrame functions only. Windows are built per (conversation, span), a bounded group; the running sums are Spark window
functions over a conversation, which spill, so a long conversation is no single row. ``read_back`` joins the
windows of a conversation again because its digests are defined over the whole conversation.

Defined results: null text or role is empty; turns are ordered by (turn, role, text), nulls first, so ties and repeated
rows have one order and all stay; rows with a null conversation id form one conversation; an empty table gives no
window; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_RUN, table

ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c")]
END = "</s>"


@dataclass(frozen=True)
class WindowBudget:
    span_tokens: int = 256       # of the turns under the mask's window
    history_turns: int = 2       # repeated turns before a span
    history_tokens: int = 64     # of the repeated turns together


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in ESCAPES[::-1]:
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_windows(turns: DataFrame, budget: WindowBudget = WindowBudget()) -> DataFrame:
    """Rows (conv_id, window_no, formatted, n_repeated, loss): ``n_repeated`` leading turns of ``formatted`` are repeats,
    ``loss`` holds (start, length) in code points, 0-based, of the masked texts."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    t = turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    t = t.withColumn("tok", F.regexp_count("text", F.lit(WS_RUN.replace("[", "[^"))).cast("long") + 1)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("seq", F.row_number().over(order).cast("long"))
    t = t.withColumn("is_sys", (F.col("role") == "system") & (F.col("seq") == 1))
    cost = F.when(F.col("is_sys"), 0).otherwise(F.col("tok"))
    half = max(1, budget.span_tokens // 2)
    big = (cost > half).cast("long")
    t = t.withColumn("start", F.coalesce(F.sum(cost).over(before), F.lit(0)))
    t = t.withColumn("slot", F.floor(F.col("start") / half))
    t = t.withColumn("bigs", 2 * F.coalesce(F.sum(big).over(before), F.lit(0)) + big)
    # the system turn belongs to the first span
    changed = F.coalesce((F.lag("slot").over(order) != F.col("slot")) | (F.lag("bigs").over(order) != F.col("bigs")), F.lit(False)) & ~F.coalesce(F.lag("is_sys").over(order), F.lit(False))
    t = t.withColumn("new", changed.cast("long")).withColumn("win", F.sum("new").over(upto))
    t = t.withColumn("sys", F.first(F.when(F.col("is_sys"), F.struct("role", "text"))).over(upto))
    # a turn is repeated in the window that begins k turns later, when what lies between fits the history budget
    later = [F.when((F.lead("new", k).over(order) == 1) & (F.lead("start", k).over(order) - F.col("start") <= budget.history_tokens) & ~F.col("is_sys"), F.lead("win", k).over(order)) for k in range(1, budget.history_turns + 1)]
    t = t.withColumn("rep", F.array_distinct(F.array_compact(F.array(F.lit(None).cast("long"), *later))))
    shown = F.concat(F.array(F.struct(F.col("win").alias("win"), F.lit(False).alias("rep"))), F.transform("rep", lambda w: F.struct(w.alias("win"), F.lit(True).alias("rep"))))
    t = t.withColumn("to", F.explode(shown))
    lead = F.when((F.col("to.win") > 0) & F.col("sys").isNotNull(), F.col("sys"))
    t = t.select("conv_id", F.col("to.win").alias("window_no"), lead.alias("sys"),
                 F.struct("seq", F.col("to.rep").alias("rep"), "role", "text").alias("x"))
    g = t.groupBy("conv_id", "window_no").agg(F.first("sys").alias("sys"), F.sort_array(F.collect_list("x")).alias("x"))
    first = F.when(F.col("sys").isNull(), F.filter("x", lambda x: F.lit(False))).otherwise(
        F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(True).alias("rep"), F.col("sys.role").alias("role"), F.col("sys.text").alias("text"))))
    piece = lambda x: F.struct(x["rep"].alias("rep"), F.concat(F.lit("["), escape(x["role"]), F.lit("]")).alias("head"), escape(x["text"]).alias("body"), (~x["rep"] & (x["role"] == "assistant")).alias("loss"))
    g = g.withColumn("y", F.transform(F.concat(first, "x"), piece))
    size = lambda y: F.length(y["head"]) + F.length(y["body"]) + len(END)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    masked = F.aggregate("y", state, lambda s, y: F.struct(
        (s["at"] + size(y)).alias("at"),
        F.when(y["loss"], F.concat(s["loss"], F.array(F.struct((s["at"] + F.length(y["head"])).alias("start"), F.length(y["body"]).alias("length"))))).otherwise(s["loss"]).alias("loss")))
    return g.select("conv_id", "window_no", F.array_join(F.transform("y", lambda y: F.concat(y["head"], y["body"], F.lit(END))), "").alias("formatted"),
                    F.size(F.filter("y", lambda y: y["rep"])).alias("n_repeated"), masked["loss"].alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Rows (conv_id, turns array<struct<role,text>>, loss_texts array<string>, formatted_chars) parsed from the windows."""
    parts = F.split("formatted", END)
    own = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turn = lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(2)), "]", 1)).alias("role"), unescape(F.substring_index(p, "]", -1)).alias("text"))
    loss = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    w = windows.select("conv_id", F.struct("window_no", F.transform(own, turn).alias("turns"), loss.alias("loss")).alias("w"), F.length("formatted").cast("long").alias("chars"))
    g = w.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", F.flatten("w.turns").alias("turns"), F.flatten("w.loss").alias("loss_texts"), "formatted_chars")


def op9_budgeted_windows(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(1, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), F.lit(says).alias("text"))
    conv = conv.unionByName(extra.withColumn("turn", F.col("turn").cast("long")))
    back = read_back(format_windows(conv))
    loss = F.array_join("loss_texts", "")
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def _oracle(b: WindowBudget = WindowBudget()) -> str:
    esc = "replace(replace(replace(replace({0}, chr(92), chr(92) || 'b'), '<', chr(92) || 'l'), '[', chr(92) || 'o'), ']', chr(92) || 'c')"
    leads = ", ".join(f"CASE WHEN lead(new, {k}) OVER o = 1 AND lead(start, {k}) OVER o - start <= {b.history_tokens} AND NOT is_sys THEN lead(win, {k}) OVER o END" for k in range(1, b.history_turns + 1))
    half = max(1, b.span_tokens // 2)
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
a AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq FROM c),
s AS (SELECT *, role = 'system' AND seq = 1 AS is_sys, CASE WHEN role = 'system' AND seq = 1 THEN 0 ELSE tok END AS cost FROM a),
p AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  2 * coalesce(sum((cost > {half})::INT) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (cost > {half})::INT AS bigs FROM s),
n AS (SELECT *, (coalesce(lag(floor(start / {half})) OVER o <> floor(start / {half}) OR lag(bigs) OVER o <> bigs, false) AND NOT coalesce(lag(is_sys) OVER o, false))::INT AS new
  FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY seq)),
v AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY seq) AS win FROM n),
r AS (SELECT *, list_distinct(list_filter([{leads}], lambda x: x IS NOT NULL)) AS rep FROM v WINDOW o AS (PARTITION BY conv_id ORDER BY seq)),
m AS (SELECT conv_id, length('[' || {esc.format('role')} || ']' || {esc.format('text')} || '</s>') AS chars, len(rep) + 1 AS times, is_sys FROM r),
w AS (SELECT conv_id, max(win) AS later FROM r GROUP BY conv_id),
f AS (SELECT conv_id, sum(chars * CASE WHEN is_sys THEN 1 + later ELSE times END)::BIGINT AS formatted_chars FROM m JOIN w USING (conv_id) GROUP BY conv_id)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM a JOIN f USING (conv_id) GROUP BY conv_id"""


QUERIES = {"op9_budgeted_windows": op9_budgeted_windows}
ORACLE = {"op9_budgeted_windows": _oracle()}
