"""Data-quality audits: duplicates, missing and impossible values, orphans, variants, order and text features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmesh.functions.text import is_missing, trim
from kinmesh.functions.times import format_of, parse
from kinmesh.operators.skew import exact_median

def exact_duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows beyond the first of each group of equal ones, and such groups.  Grouped by a hash and length; the values don't travel."""
    key = [F.sha2(F.to_json(F.struct(*columns)), 256).alias("k")]
    by = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return by.agg(F.sum(F.col("n") - 1).alias("extra_rows"), F.count(F.lit(1)).alias("groups"))


def near_duplicates(rows: DataFrame, key: str, time: str, others: list[str], seconds: int = 60) -> DataFrame:
    """Rows that repeat an earlier row of their key but for a time that differs by 1 to `seconds`."""
    w = Window.partitionBy(key, *others).orderBy(time)
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    gap = at(F.col(time)) - at(F.lag(time).over(w))
    return rows.withColumn("gap", gap).where(F.col("gap").between(1, seconds))


def missingness(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    kinds = dict(rows.dtypes)
    test = lambda c: is_missing(F.col(c)) if kinds[c] == "string" else F.col(c).isNull()
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *(F.count_if(test(c)).alias(f"{c}_missing") for c in columns))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    lost = child.join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
    return lost.join(child.agg(F.count(F.lit(1)).alias("total")))


def category_variants(columns: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return reduce(DataFrame.unionByName, (df.agg(F.count_distinct(c).alias("variants")).select(F.lit(name).alias("category"), "variants") for name, (df, c) in columns.items()))


def text_features(rows: DataFrame, c: str) -> DataFrame:
    has = lambda p: F.count_if(F.col(c).rlike(p))
    return rows.agg(F.count_if(F.col(c).contains(",")).alias("comma"), F.count_if(F.col(c).contains('"')).alias("quote"), F.count_if(F.col(c).contains("\n")).alias("line_break"), has(r"[\x{10000}-\x{10FFFF}]").alias("astral"), has(r"[\x{0900}-\x{097F}]").alias("devanagari"))


def inversions(rows: DataFrame, by: str, order: str, time: str) -> DataFrame:
    """How often a time is before that of the row ahead of it in file order; rows without a time are passed over."""
    prior = F.lag(time).over(Window.partitionBy(by).orderBy(order))
    known = rows.where(F.col(time).isNotNull()).select(by, time, prior.alias("prior"))
    return known.groupBy(by).agg(F.count_if(F.col(time) < F.col("prior")).alias("inversions"))


def impossible_orders(orders: DataFrame, factor: float = 3.0, last: str = "1998-01-01") -> DataFrame:
    """Keys of orders with a negative or outsized total, by the exact median, or a date beyond the last."""
    median = exact_median(orders, "o_totalprice").select(F.col("median").alias("m"))
    high = orders.join(F.broadcast(median)).where(F.col("o_totalprice") >= factor * F.col("m")).select("o_orderkey")
    low = orders.where((F.col("o_totalprice") < 0) | (F.col("o_orderdate") > F.lit(last).cast("timestamp_ntz"))).select("o_orderkey")
    return low.union(high).distinct()


# ---------------------------------------------------------------- cleaners of the audit (not those of normalization)


def peeled(x: Column) -> Column:
    """Trimmed text without the matching quotes around it, however many."""
    return F.trim(F.regexp_replace(F.trim(x), r"""^(?:"+(?=[^"]*"+$)|'+(?=[^']*'+$))|(?<=.)(?:"+|'+)$""", ""))


def absent(x: Column) -> Column:
    return x.isNull() | F.lower(peeled(x)).isin("", "null", "none")


def clean_words(x: Column) -> Column:
    """Lower-cased words of letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(peeled(x)), r"[^\p{L}\p{N}]+", " "))


def clean_email(x: Column, dotless: str = "gmail.com") -> Column:
    """Lower-cased; at the one domain that ignores them, dots and plus suffixes are dropped."""
    e = F.lower(peeled(x))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    return F.when(e.contains("@"), F.when(domain == dotless, F.concat(F.regexp_replace(F.substring_index(local, "+", 1), r"\.", ""), F.lit("@"), domain)).otherwise(e))


def clean_phone(x: Column, prefix: str = "999") -> Column:
    """Digits without the country prefix and leading zeros; a number of one digit repeated stays as it is."""
    d = F.regexp_replace(peeled(x), "[^0-9]", "")
    bare = F.regexp_replace(F.regexp_replace(d, f"^(?:00)?{prefix}(?=[0-9]{{7,}}$)", ""), "^0+(?=.)", "")
    return F.when(d.rlike(r"^([0-9])\1*$"), d).when(d != "", bare)


def record_tokens(rows: DataFrame, fields: dict[str, str], names: tuple[str, ...] = (), city: str | None = None) -> DataFrame:
    """rid and token for each naive identifier that a record holds: kind:value, with name and city as one.  fields: kind -> column."""
    clean = {"email": clean_email, "phone": clean_phone}
    parts = [F.when(~absent(F.col(c)), F.concat(F.lit(f"{k}:"), clean.get(k, peeled)(F.col(c)))) for k, c in fields.items()]
    parts += [F.when(~absent(F.col(n)) & ~absent(F.col(city)), F.concat(F.lit("name_city:"), clean_words(F.col(n)), F.lit("|"), clean_words(F.col(city)))) for n in names if city]
    return rows.select("rid", F.explode(F.array_distinct(F.array_compact(F.array(*parts)))).alias("token"))


def worthless_tokens(tokens: DataFrame, poison: tuple[str, ...] = (), most: int = 40) -> DataFrame:
    """token, n and why: on more than most records, or poison by name."""
    by = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    named = F.col("token").isin(*poison) if poison else F.lit(False)
    return by.where(named | (F.col("n") > most)).withColumn("why", F.when(named, "poison").otherwise("frequency"))


# ---------------------------------------------------------------- shapes, behaviour, lateness


def payload_shapes(rows: DataFrame, by: str, payload: str) -> DataFrame:
    """How often each set of keys occurs in a JSON object column."""
    keys = F.array_join(F.array_sort(F.json_object_keys(F.col(payload))), ",")
    return rows.groupBy(by, keys.alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def behaviour(rows: DataFrame, by: str, time: str, value: str) -> DataFrame:
    """Of each actor: rows, seconds from its first to its last, the mean step and the largest value; sums only, so that one actor may have a third of all rows."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    out = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), ((F.max(micros) - F.min(micros)) / 1e6).alias("span"), F.max(value).alias("most"))
    return out.select(by, "n", F.round("span", 3).alias("span"), F.round(F.try_divide("span", F.col("n") - 1), 3).alias("mean_step"), "most")


def share_of_people(rows: DataFrame, person: str, flag: Column) -> DataFrame:
    """One row: people, those with a flagged row, and their share."""
    by = rows.groupBy(person).agg(F.max(F.coalesce(flag, F.lit(False)).cast("int")).alias("f"))
    return by.agg(F.count(F.lit(1)).alias("people"), F.sum("f").alias("flagged")).withColumn("rate", F.round(F.try_divide(F.col("flagged") * 1.0, F.col("people")), 6))


def late_arrivals(rows: DataFrame, event: str, arrived: str, days: int = 9) -> DataFrame:
    """One row: rows with both times, those that came more than so many days after, and those that came before they happened."""
    gap = F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(F.col(event).cast("timestamp"))
    known = rows.where(F.col(event).isNotNull() & F.col(arrived).isNotNull())
    return known.agg(F.count(F.lit(1)).alias("total"), F.count_if(gap > days * 86_400_000_000).alias("late"), F.count_if(gap < 0).alias("early"))


def timestamp_counts(rows: DataFrame, raw: str) -> DataFrame:
    """Of each shape of a raw time: rows, unreadable ones, and those whose day and month could change places."""
    x = F.col(raw)
    swap = trim(x).rlike(r"^(0[1-9]|1[0-2])-(0[1-9]|1[0-2])-\d{2}") & (F.substring(trim(x), 1, 2) != F.substring(trim(x), 4, 2))
    return rows.groupBy(format_of(x).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count_if(parse(x).isNull()).alias("unreadable"), F.count_if(swap).alias("ambiguous"))


def missing_effect(rows: DataFrame, column: str, group: str, of: str, against: str) -> DataFrame:
    """One row: the shares missing in two groups and their effect size (Cohen's h)."""
    share = lambda g: F.try_divide(F.count_if(absent(F.col(column).cast("string")) & (F.col(group) == g)) * 1.0, F.count_if(F.col(group) == g))
    two = rows.agg(share(of).alias("a"), share(against).alias("b"))
    return two.select(F.round("a", 6).alias("share"), F.round("b", 6).alias("other_share"), F.round(2 * F.asin(F.sqrt("a")) - 2 * F.asin(F.sqrt("b")), 5).alias("effect"))
