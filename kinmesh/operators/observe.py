"""Long-form observations: one row for each record and mapped field, and their statistics."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmesh.functions import text


IDS = "rid, source, record_ordinal, source_record_id"


def _each_value(records: DataFrame, fields: dict[str, dict[str, str]], build: Callable[[str, str, bool], str], record_ids: bool, only: str = "") -> DataFrame:
    """IDS and build(field, concept, plain)'s struct o for each record and field.  Each field is a projection of its own (its column and the ids are all
    that a columnar source reads for it), small enough for the JVM to compile well.  Only values that need them reach the Arrow functions: those are
    exploded from the records that have any.  only: a condition on o.  It is applied inside a generator, since a filter over the projection is pushed
    below it and builds o again for every mention."""
    spark = records.sparkSession
    text.register(spark)
    parts, column = [], lambda f: f"cast(`{f}` AS string)"
    for source, own in fields.items():
        pairs = sorted({*own.items(), *([("source_record_id", "source_record_id")] if record_ids else [])})
        here, plain = f"source = {text.literal(source)}", {f: text.is_plain(column(f), c) for f, c in pairs}
        one = lambda x: f"explode(filter(array({x}), o -> {only}))" if only else x
        parts += [f"SELECT {IDS}, {one(build(f, c, True))} AS o FROM records WHERE {here} AND {plain[f]}" for f, c in pairs]
        odd = ", ".join(f"named_struct('odd', NOT {plain[f]}, 'o', {build(f, c, False)})" for f, c in pairs)
        parts.append(f"SELECT {IDS}, v.o FROM (SELECT {IDS}, explode(array({odd})) AS v FROM records WHERE {here} AND NOT ({' AND '.join(plain.values())})) WHERE v.odd{' AND ' + re.sub(r'\bo\.', 'v.o.', only) if only else ''}")
    whole = " UNION ALL ".join(parts).replace("{", "{{").replace("}", "}}").replace("FROM records", "FROM {records}")
    return spark.sql(whole, records=records)


def observations(records: DataFrame, fields: dict[str, dict[str, str]], verified: str | None = None) -> DataFrame:
    """Unpivot records (rid, source, record_ordinal, source_record_id and raw columns) by fields (source -> raw field -> concept).  verified: a
    condition under which a record's e-mail is verified.

    Each field's value is normalized as its own expression, so no row is dispatched by concept.  A field that a source lacks
    gives no row; a null value of one it has is missing.
    """

    def build(field: str, concept: str, plain: bool) -> str:
        raw = f"cast(`{field}` AS string)"
        role = "'source_record_key'" if field == "source_record_id" else f"if({verified}, 'verified_identifier', 'observed_identifier')" if verified and concept == "email" else "'observed_identifier'"
        return f"named_struct('raw_field', {text.literal(field)}, 'canonical_concept', '{concept}', 'raw_value', {raw}, 'profiling_key', {text.profiling(raw, concept, plain)}, 'n', {text.normalized(raw, concept, plain)}, 'evidence_role', {role})"

    return _each_value(records, fields, build, True).selectExpr(
        *IDS.split(", "), "o.raw_field", "o.canonical_concept", "o.raw_value", "o.profiling_key", "o.n.value AS normalized_value", "o.n.status AS normalization_status",
        "o.n.status = 'valid' AND o.n.value <> o.raw_value AS normalization_changed", "o.n.transformation AS transformation", "o.n.flags AS quality_flags", "o.evidence_role",
    )


def record_values(records: DataFrame, fields: dict[str, dict[str, str]], verified: str | None = None) -> DataFrame:
    """Distinct (rid, source, concept, value, verified) of the records' valid values, record ids aside.  Values are shuffled only for sources that
    map two fields to one concept; elsewhere a record has each value once by itself."""

    def build(field: str, concept: str, plain: bool) -> str:
        sure = f"coalesce({verified}, false)" if verified and concept == "email" else "false"
        return f"named_struct('concept', '{concept}', 'n', {text.normalized(f'cast(`{field}` AS string)', concept, plain)}, 'verified', {sure})"

    def of(some: dict[str, dict[str, str]]) -> DataFrame:
        return _each_value(records, some, build, False, "o.n.status = 'valid' AND o.n.value <> ''").selectExpr("rid", "source", "o.concept", "o.n.value", "o.verified")

    doubled = {s: m for s, m in fields.items() if len(set(m.values())) < len(m)}
    single = {s: m for s, m in fields.items() if s not in doubled}
    return reduce(DataFrame.unionByName, [*([of(single)] if single else []), *([of(doubled).distinct()] if doubled else [])])


def valid(obs: DataFrame) -> DataFrame:
    return obs.where("normalization_status = 'valid' AND normalized_value <> ''")


def field_statistics(obs: DataFrame) -> DataFrame:
    """Counts of each source, field and concept, with percentages of all rounded to 6."""
    n = F.count(F.lit(1))
    count = lambda c: F.count_if(c)
    out = obs.groupBy("source", "raw_field", "canonical_concept").agg(
        n.alias("total"),
        count(F.col("normalization_status") == "missing").alias("missing"),
        count(F.col("normalization_status") == "valid").alias("valid"),
        count(F.col("normalization_status") == "invalid").alias("invalid"),
        count(F.coalesce("normalization_changed", F.lit(False))).alias("changed"),
        count(F.size("quality_flags") > 0).alias("flagged"),
    )
    return out.withColumns({"valid_pct": F.round(F.col("valid") * 100.0 / F.col("total"), 6), "missing_pct": F.round(F.col("missing") * 100.0 / F.col("total"), 6)})


def issues(obs: DataFrame) -> DataFrame:
    """How often each quality flag occurs, by source, field and concept."""
    return obs.select("source", "raw_field", "canonical_concept", F.explode("quality_flags").alias("flag")).groupBy("source", "raw_field", "canonical_concept", "flag").agg(F.count(F.lit(1)).alias("n"))


def transformations(obs: DataFrame) -> DataFrame:
    return obs.groupBy("source", "raw_field", "canonical_concept", "transformation").agg(F.count(F.lit(1)).alias("n"))
