"""Joins, caps and ranks that no hot key and no global order turns into one task's work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.storage import keep, partitions

#: A key is hot if it has more than both these rows and this share of all rows: so at most HOT_MOST keys are.
HOT_ROWS, HOT_MOST = 100_000, 10_000


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int = HOT_ROWS, most: int = HOT_MOST) -> DataFrame:
    """left (a kept table: it is read more than once) inner-joined with right, which is unique in key.  Hot keys of left get their rows of right by
    broadcast, `most` rows at most; the rest meet in a shuffle in which no key has more rows than the bound."""
    n = left.count()
    bound = max(rows, -(-n // most))
    if n <= bound:
        return left.join(right, key)
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound).select(key)
    by_broadcast = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key)
    return left.join(F.broadcast(hot), key, "left_anti").join(right, key).unionByName(by_broadcast)


def within(rows: DataFrame, keys: list[str], order: list[str], least: int, most: int) -> DataFrame:
    """The rows whose key has `least` to `most` rows.  Only the first most + 1 rows of a key by order can tell, and Spark drops the others on
    the map side (a group limit under the ranking window), so a key that all rows share moves most + 1 rows a task."""
    by = Window.partitionBy(*keys)
    return _first(rows, keys, order, most).withColumn("__n", F.max("__place").over(by)).where(F.col("__n").between(least, most)).drop("__place", "__n")


def gathered_within(rows: DataFrame, keys: list[str], value: str, least: int, most: int) -> DataFrame:
    """keys and m, the sorted values of each key that has `least` to `most` rows: within and a gathering in one, since the list tells the number."""
    lists = _first(rows, keys, [value], most).groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("m"))
    return lists.where(F.size("m").between(least, most))


def _first(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__place") <= most + 1)


def running(rows: DataFrame, order: list[str], amount: Column, name: str) -> DataFrame:
    """rows with the running sum of amount (itself included) in order.  Rows are dealt into ranges of the order; sums of earlier ranges, a row a
    range, are added to the sums inside each.  rows must be distinct in order."""
    spark = rows.sparkSession
    dealt = keep(rows.repartitionByRange(partitions(spark), *order).withColumn("__range", F.spark_partition_id()), "ranges")
    # ids of ranges are numbers of partitions, which rise with the order
    sums = dealt.groupBy("__range").agg(F.sum(amount).alias("__sum"))
    before = sums.select("__range", (F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__sum")).alias("__before"))
    inside = F.sum(amount).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("__inside", inside).join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__inside")).drop("__range", "__before", "__inside")


def at_places(rows: DataFrame, value: str, places: Callable[[Column], list[tuple[Column, Column]]]) -> DataFrame:
    """place, value: the values at 0-based places of the sorted non-null values.  places(n) gives (name, place) columns from the number of values.  Values are
    counted first, so many equal ones cost one row."""
    by = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("__k"))
    placed = running(by, ["value"], F.col("__k"), "__upto")
    total = placed.agg(F.sum("__k").alias("__n"))
    want = total.select(F.explode(F.array(*(F.struct(n.alias("place"), p.cast("long").alias("__at")) for n, p in places(F.col("__n"))))).alias("__w")).select("__w.*")
    return placed.join(F.broadcast(want), (F.col("__at") < F.col("__upto")) & (F.col("__at") >= F.col("__upto") - F.col("__k"))).select("place", "value")


def exact_median(rows: DataFrame, value: str) -> DataFrame:
    """One row: median, the mean of the two middle values."""
    two = at_places(rows, value, lambda n: [(F.lit(0), F.floor((n - 1) / 2)), (F.lit(1), F.floor(n / 2))])
    return two.agg(F.avg("value").alias("median"))
