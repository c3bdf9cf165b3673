"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns (same turn number, role and text, counted from the first turn) is rendered once, as the
prompt; the turns after it are rendered twice, as the chosen and the rejected completion. The result has a row for each
rendered turn, so a conversation of any length is never gathered in one place: part (prompt, chosen or rejected), turn,
rendered, and the mask: loss_start and loss_end bound the characters of rendered that count for the loss. They are the
text and end mark of an assistant's turn in a completion, and nothing else. Concatenating a part's rows by turn gives the
part's text.

Everything is DataFrame operations: one aggregation by (pair, turn) brings a pair's turns side by side, one by pair finds
the first turn that differs, and a join puts both together.

Defined cases: a null turn is -1; null role and text are empty. Rows without conv_id are in no pair. Of rows that repeat
a conversation's turn the least (role, text) stands. A conversation without partner differs from its first turn on. Pairs
that are equal throughout have a prompt only. Conversations may have any number of turns; only two texts meet in a row. Other
columns of turns are left out. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"


def preference_segments(turns: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """pair_id, chosen_id, rejected_id, part, turn, role, rendered, loss_start, loss_end. turns has conv_id, turn, role and
    text; pairs has pair_id, chosen_id and rejected_id. Without pairs, conversation 2 n is chosen and 2 n + 1 rejected."""
    t = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if pairs is None:
        sided = t.select(F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("first"), "conv_id", "turn", "role", "text")
    else:
        ends = pairs.select("pair_id", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(False).alias("first"), F.col("rejected_id").alias("conv_id")))).alias("e")).select("pair_id", "e.*")
        sided = t.join(ends, "conv_id").select("pair_id", "first", "conv_id", "turn", "role", "text")
    said = F.struct("role", "text", "conv_id")
    both = sided.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("first"), said)).alias("c"), F.min(F.when(~F.col("first"), said)).alias("r"))
    alike = (F.col("c.role") == F.col("r.role")) & (F.col("c.text") == F.col("r.text"))
    both = both.withColumn("alike", F.coalesce(alike, F.lit(False)))
    differ = both.groupBy(F.col("pair_id").alias("p")).agg(F.min(F.when(~F.col("alike"), F.col("turn"))).alias("cut"), F.max("c.conv_id").alias("chosen_id"), F.max("r.conv_id").alias("rejected_id"))
    placed = both.join(differ, F.col("pair_id") == F.col("p"))
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = lambda name, side: F.struct(F.lit(name).alias("part"), F.col(f"{side}.role").alias("role"), F.col(f"{side}.text").alias("text"))
    parts = F.when(common, F.array(part("prompt", "c"))).otherwise(F.filter(F.array(part("chosen", "c"), part("rejected", "r")), lambda x: x["role"].isNotNull()))
    rows = placed.select("pair_id", "chosen_id", "rejected_id", "turn", F.explode(parts).alias("x")).select("*", "x.*").drop("x")
    rendered = F.concat(F.lit(HEAD), "role", F.lit(BODY), "text", F.lit(END))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    head = F.length("role") + len(HEAD) + len(BODY)
    return rows.select("pair_id", "chosen_id", "rejected_id", "part", "turn", "role", rendered.alias("rendered"), F.when(learned, head).otherwise(0).cast("long").alias("loss_start"), F.when(learned, F.length(rendered)).otherwise(0).cast("long").alias("loss_end"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """
WITH t AS (SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 = 0 AS first, conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT pair_id, max(CASE WHEN first THEN conv_id END) AS chosen_id, max(CASE WHEN NOT first THEN conv_id END) AS rejected_id FROM t GROUP BY pair_id),
b AS (SELECT pair_id, turn, c.role AS cr, c.text AS ct, r.role AS rr, r.text AS rt FROM (SELECT * FROM t WHERE first) c FULL JOIN (SELECT * FROM t WHERE NOT first) r USING (pair_id, turn)),
k AS (SELECT pair_id, min(CASE WHEN coalesce(cr = rr AND ct = rt, false) THEN NULL ELSE turn END) AS cut FROM b GROUP BY pair_id),
x AS (SELECT pair_id, turn, 'prompt' AS part, cr AS role, ct AS text FROM b JOIN k USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL SELECT pair_id, turn, 'chosen', cr, ct FROM b JOIN k USING (pair_id) WHERE turn >= cut AND cr IS NOT NULL
  UNION ALL SELECT pair_id, turn, 'rejected', rr, rt FROM b JOIN k USING (pair_id) WHERE turn >= cut AND rr IS NOT NULL)
SELECT pair_id, chosen_id, rejected_id, part, turn, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CASE WHEN part != 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END::BIGINT AS loss_start,
  CASE WHEN part != 'prompt' AND role = 'assistant' THEN length(role) + length(text) + 13 ELSE 0 END::BIGINT AS loss_end
FROM x JOIN ids USING (pair_id)
"""
