"""Runs in logs, and their alignment with metric rows. Everything is partitioned by source, so that no window holds all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINE = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}) [A-Z]+: .*Stored triples for chunk ([0-9]+)/"


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ts, root) of the lines that tell a stored chunk; lines about requests don't count."""
    hit = lines.filter(F.col(line).rlike(LINE) & ~F.contains(line, F.lit("HTTP Request:")))
    return hit.select("*", F.try_to_timestamp(F.regexp_extract(line, LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss,SSS")).alias("ts"), F.regexp_extract(line, LINE, 2).alias("root"))


def transitions(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The rows at which the value differs from the row before; before the first there is null."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.col(value))).drop("__before")


def nearest(left: DataFrame, right: DataFrame, by: str, ts: str, left_id: str, right_id: str) -> DataFrame:
    """left with right_id and micros: the row of right nearest in time within by; of equally near ones the earlier, then
    the smaller id. One sort of both sides: the last before and the first after each row are carried along."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    a = left.select(by, micros.alias("t"), F.col(left_id).alias("l"), F.lit(None).cast("struct<t:bigint,r:bigint>").alias("m"))
    b = right.select(by, micros.alias("t"), F.lit(None).cast("bigint").alias("l"), F.struct(micros.alias("t"), F.col(right_id).cast("bigint").alias("r")).alias("m"))
    both = a.unionByName(b)
    order = Window.partitionBy(by).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # backwards from the end, so that this frame grows too, instead of being taken anew for each row
    ahead = Window.partitionBy(by).orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    neg = F.struct(F.col("m.t").alias("t"), (-F.col("m.r")).alias("r"))
    found = both.withColumn("p", F.max(F.when(F.col("m").isNotNull(), neg)).over(order)).withColumn("n", F.min("m").over(ahead)).filter(F.col("l").isNotNull())
    before, after = F.col("t") - F.col("p.t"), F.col("n.t") - F.col("t")
    use_before = F.coalesce(before <= after, F.col("p").isNotNull())
    out = found.select(F.col("l").alias(left_id), F.when(use_before, -F.col("p.r")).otherwise(F.col("n.r")).alias(right_id), F.when(use_before, before).otherwise(after).alias("micros"))
    return out.filter(F.col(right_id).isNotNull())


def filled(rows: DataFrame, by: list[str], order: list[str], value: Column, to: str) -> DataFrame:
    """rows with the last value so far that isn't null."""
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def stretches(rows: DataFrame, by: list[str], order: list[str], marker: Column) -> DataFrame:
    """The rows with the marker, with the numbers first and last of the rows that they stand for: up to the next marker; last is
    null for the last one."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    marked = rows.withColumn("first", number).filter(marker)
    return marked.withColumn("last", F.lead("first").over(Window.partitionBy(*by).orderBy("first")) - 1)


def report(docs: DataFrame, metrics: DataFrame, counts: DataFrame, key: str, order: str) -> DataFrame:
    """The first metric row of each document, with its token count if there is one; documents without metrics are left
    out."""
    first = metrics.groupBy(key).agg(F.min_by(F.struct(*metrics.columns), order).alias("m")).select("m.*")
    return docs.join(first, key).join(counts, key, "left")
