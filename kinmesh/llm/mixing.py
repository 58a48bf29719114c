"""Mixing sources to target weights by weighted fair queueing.  DataFrame operations only.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``.  Sources in code point order, null last,
weigh 3, 1, 2, repeating.  They share SHARE times all sizes by weight; a target stops at MOST times its
source's size, and the excess is shared again by weight until none is above.

Each document is put in a fixed shuffled order within its source.  Its virtual finish time is the source's
cumulative size, itself included, divided by the source's target; its second use comes after the source's
first round.  All uses are sorted by finish time over ranges of it, and taken until the budget, the sum of
the targets, is spent; the last one may be taken in part.

Running sums are taken in buckets (of the shuffle hash within a source; of the finish time overall), shifted
by the sums of earlier buckets, so no source and no range is ever one task's.  Ties go by finish time,
source, shuffle hash, doc_id, size, round; rows equal in all of these are alike.

Null text: size 0, takes nothing.  Null doc_id: shuffled by its text.  A source without words has target 0.
Repeated rows each take part.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.llm.quality import words
from kinmesh.llm.shared import WORD, keep

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Hex digits of the shuffle hash that name a bucket, and ranges of finish time between 0 and 1.
BUCKET_DIGITS = 3
RANGES = 4096


def sizes(docs: DataFrame) -> DataFrame:
    """row, doc_id, source, size, turn (the shuffle hash)."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.col("text")), F.lit("none"))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("row", "doc_id", "source", size.alias("size"), F.md5(F.concat(F.lit(SEED + ":"), key)).alias("turn"))


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, budget: a row a source.  With sources by cap per weight, the common level is
    (total - caps before) / (weights from here on) where it is highest; a target is weight times level, or its cap."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    every = Window.partitionBy()
    by = by.withColumns({"weight": weight, "cap": (F.lit(MOST) * F.col("source_size")).cast("double"), "total": F.lit(SHARE) * F.sum("source_size").over(every)})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") - before) / rest)
    by = by.withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(every)))
    return by.select("source", "source_size", "target", F.floor(F.least("total", F.sum("cap").over(every))).cast("long").alias("budget"))


def _running(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """rows with the running sum of size (itself included) within keys, by bucket and then order."""
    sums = rows.groupBy(*keys, bucket).agg(F.sum("size").alias("__n"))
    before = (F.sum("__n").over(Window.partitionBy(*keys).orderBy(bucket)) - F.col("__n")).alias("__before")
    sums = sums.select(*(F.col(k).alias(f"__{k}") for k in (*keys, bucket)), before)
    on = [rows[k].eqNullSafe(sums[f"__{k}"]) for k in (*keys, bucket)]
    inside = F.sum("size").over(Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, on).select(*rows.columns, (F.col("__before") + inside).alias(name))


def take(sized: DataFrame) -> DataFrame:
    """row, doc_id, size, source_size, target, taken."""
    of = targets(sized)
    own = of.select(F.col("source").alias("__source"), "source_size", "target", "budget")
    rows = sized.withColumn("bucket", F.substring("turn", 1, BUCKET_DIGITS))
    order = [F.col("turn"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("row")]
    rows = keep(_running(rows, ["source"], "bucket", order, "done").join(own, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "bucket"), "mix")
    uses = rows.where("size > 0").select("row", "doc_id", "source", "size", "turn", "budget", F.explode(F.array([F.struct(F.lit(n).alias("round"), ((F.lit(n).cast("long") * F.col("source_size") + F.col("done")) / F.col("target")).alias("finish")) for n in range(MOST)])).alias("use")).select("*", "use.round", "use.finish").drop("use")
    # even steps up to 1, where nearly all that is taken ends; even ratios beyond, however late the last one is
    late = F.lit(1.0) + F.log2(F.greatest("finish", F.lit(1.0)))
    uses = uses.withColumn("range", F.floor(F.least(F.col("finish"), late) * RANGES))
    by = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("turn"), F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("round"), F.col("row")]
    placed = _running(uses, [], "range", by, "spent")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - (F.col("spent") - F.col("size"))))
    taken = placed.groupBy("row").agg(F.sum(part).alias("taken"))
    return rows.join(taken, "row", "left").select("row", "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    numbered = docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())
    return take(keep(sizes(numbered), "sizes")).drop("row")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with docs' columns: a document comes as often as it is taken whole, not at all if it isn't
    taken, and the one that the budget cuts comes with its first words, joined by spaces (n_chars counted anew)."""
    whole = keep(docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "whole")
    plan = take(keep(sizes(whole.select("row", "doc.doc_id", "doc.source", "doc.text")), "sizes")).where("taken > 0").select("row", "size", "taken")
    full, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = whole.join(plan, "row").select("doc", F.explode(parts).alias("part"))
    text = F.array_join(F.slice(words(F.col("doc")["text"]), F.lit(1), F.col("part").cast("int")), " ")
    new = {"text": text, "n_chars": F.length(text)}
    return rows.select(*(F.when(F.col("part") > 0, new[c]).otherwise(F.col("doc")[c]).cast(docs.schema[c].dataType).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))


#: mix_report(documents) in DuckDB's SQL.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, 'none')) AS turn FROM documents),
by_source AS (
  SELECT source, source_size, CAST({MOST} * source_size AS DOUBLE) AS cap, CAST({SHARE} AS DOUBLE) * sum(source_size) OVER () AS total,
    [{", ".join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM by_source),
targets AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target, CAST(floor(least(total, sum(cap) OVER ())) AS BIGINT) AS budget FROM levels),
ordered AS (
  SELECT s.*, t.source_size, t.target, t.budget, row_number() OVER () AS row,
    sum(size) OVER (PARTITION BY s.source ORDER BY turn, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS done
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
uses AS (
  SELECT o.*, r.round, CAST(r.round * source_size + done AS DOUBLE) / target AS finish FROM ordered o, (SELECT unnest(range({MOST})) AS round) r WHERE size > 0),
placed AS (
  SELECT row, greatest(0, least(size, budget - (sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, doc_id NULLS LAST, size, round ROWS UNBOUNDED PRECEDING) - size))) AS part FROM uses)
SELECT o.doc_id, o.size, o.source_size, o.target, CAST(coalesce(p.taken, 0) AS BIGINT) AS taken
FROM ordered o LEFT JOIN (SELECT row, sum(part) AS taken FROM placed GROUP BY row) p ON o.row = p.row
"""
