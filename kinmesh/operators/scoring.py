"""Merge-confidence scores of candidate pairs, as column expressions in three projections: features, families, score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.functions import text
from kinmesh.operators.blocking import record_sets
from kinmesh.operators.skew import within
from kinmesh.storage import keep

USABLE = ("email", "hashed_email", "phone", "device_id", "account_reference", "payment_token", "provider_id", "date_of_birth", "postcode", "country")
NAMES = ("full_name", "first_name", "last_name", "city")


def usable(values: DataFrame, high: DataFrame | None = None) -> DataFrame:
    """values without those of the registry: they are neither evidence nor conflict.  Names and cities are never dropped.  Without a registry, those above
    the threshold are told by a group limit before the shuffle: no hot value's rows meet."""
    values = values.select("rid", "concept", "value")
    named, some = values.where(F.col("concept").isin(*NAMES)), values.where(F.col("concept").isin(*USABLE))
    rest = within(some, ["concept", "value"], ["rid"], 1, config.RULE2_THRESHOLD) if high is None else some.join(high.select("concept", "value"), ["concept", "value"], "left_anti")
    return rest.unionByName(named.select(rest.columns))


def records(values: DataFrame, high: DataFrame | None, verified: DataFrame, ids: DataFrame) -> DataFrame:
    """What scoring reads of a record: its value sets, derived sets and logical id.  verified: distinct (rid, value) of verified e-mails; of these the
    record's usable ones count.  high: the registry, or None (see usable)."""
    own = usable(values, high)
    sets = record_sets(own, (*USABLE, *NAMES))
    ok = verified.groupBy("rid").agg(F.collect_set("value").alias("said"))
    none = F.array().cast("array<string>")
    set_of = lambda c: F.coalesce(F.col(f"v_{c}"), none)
    derived = lambda c, f: F.array_distinct(F.array_compact(F.transform(set_of(c), f)))
    low = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    return (
        ids.join(sets, "rid", "left")
        .join(ok, "rid", "left")
        .select(
            "rid",
            "source",
            "source_record_id",
            *(set_of(c).alias(c) for c in USABLE),
            F.array_intersect(set_of("email"), F.coalesce("said", none)).alias("verified"),
            derived("email", text.email_skeleton).alias("skeleton"),
            derived("phone", text.phone_suffix).alias("suffix"),
            derived("account_reference", text.numeric_account).alias("numeric"),
            text.person_names(set_of("full_name"), set_of("first_name"), set_of("last_name")).alias("names"),
            F.array_distinct(F.transform(set_of("city"), low)).alias("cities"),
        )
    )


def _two(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    cols = [c for c in recs.columns if c != "rid"]
    side = lambda p: recs.select(F.col("rid").alias(p), F.struct(*cols).alias(f"{p}_"))
    return pairs.join(side("l"), "l").join(side("r"), "r")


def evidence(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with one boolean column for each raw feature and set conflict."""
    a, b = F.col("l_"), F.col("r_")
    meet = lambda c, d=None: F.coalesce(F.arrays_overlap(a[c], b[d or c]), F.lit(False))
    apart = lambda c: (F.size(a[c]) > 0) & (F.size(b[c]) > 0) & ~meet(c)
    shared = F.array_intersect(a["email"], b["email"])
    bridge = lambda x, y: F.when(F.size(y["hashed_email"]) > 0, F.coalesce(F.arrays_overlap(F.transform(x["email"], lambda e: F.sha2(e, 256)), y["hashed_email"]), F.lit(False))).otherwise(F.lit(False))
    trusted = F.coalesce(F.arrays_overlap(shared, F.concat(a["verified"], b["verified"])), F.lit(False))
    names = meet("names")
    return _two(recs, pairs).select(
        *pairs.columns,
        ((a["source"] == b["source"]) & (a["source_record_id"] == b["source_record_id"])).alias("same_source_record_id"),
        (meet("account_reference") | meet("numeric")).alias("exact_account_reference"),
        meet("provider_id").alias("exact_provider_id"),
        ((F.size(shared) > 0) & trusted).alias("exact_verified_email"),
        ((F.size(shared) > 0) & ~trusted).alias("exact_email"),
        ((F.size(shared) == 0) & meet("skeleton")).alias("email_skeleton"),
        (meet("hashed_email") | bridge(a, b) | bridge(b, a)).alias("email_sha256_bridge"),
        meet("phone").alias("exact_phone"),
        (~meet("phone") & meet("suffix")).alias("phone_suffix_9"),
        meet("device_id").alias("exact_device_id"),
        meet("payment_token").alias("exact_payment_token"),
        (names & meet("cities")).alias("name_city"),
        (names & meet("date_of_birth")).alias("name_date_of_birth"),
        (names & meet("postcode")).alias("name_postcode"),
        apart("numeric").alias("account_reference_conflict"),
        apart("verified").alias("verified_email_conflict"),
        (~apart("verified") & apart("skeleton")).alias("email_conflict"),
        apart("suffix").alias("phone_conflict"),
        apart("date_of_birth").alias("date_of_birth_conflict"),
        apart("names").alias("name_conflict"),
        apart("country").alias("country_conflict"),
    )


def families(rows: DataFrame) -> DataFrame:
    """The strongest feature of each family, and all conflicts, in place of the booleans."""

    def pick(features: tuple[str, ...]) -> Column:
        out = F.lit(None).cast("string")
        for f in reversed(sorted(features, key=lambda f: -config.EVIDENCE_WEIGHTS[f])):
            out = F.when(F.col(f), f).otherwise(out)
        return out

    base = [c for c in rows.columns if c not in config.EVIDENCE_WEIGHTS and c not in config.CONFLICT_PENALTIES]
    conflicts = [c for c in config.CONFLICT_PENALTIES if c in rows.columns]
    picked = rows.select(*base, *conflicts, *(pick(f).alias(f"f_{k}") for k, f in config.EVIDENCE_FAMILIES.items()))
    others = [F.col(f"f_{k}").isNull() for k in config.EVIDENCE_FAMILIES if k not in ("email", "payment")]
    household = (F.col("f_email") == "exact_email") & F.col("f_payment").isNotNull()
    for o in others:
        household = household & o
    risk = F.coalesce(household, F.lit(False)).alias("shared_email_payment_household_risk")
    named = picked.select("*", risk)
    listed = F.array_sort(F.array_compact(F.array(*(F.when(F.col(c), c) for c in config.CONFLICT_PENALTIES))))
    return named.select(*base, *(f"f_{k}" for k in config.EVIDENCE_FAMILIES), F.array_sort(F.array_compact(F.array(*(F.col(f"f_{k}") for k in config.EVIDENCE_FAMILIES)))).alias("evidence"), listed.alias("conflicts"))


def _weight(feature: Column) -> Column:
    out = F.lit(0.0)
    for f, w in config.EVIDENCE_WEIGHTS.items():
        out = F.when(feature == f, F.lit(w)).otherwise(out)
    return out


def score(rows: DataFrame) -> DataFrame:
    """evidence, conflicts, positive_score, conflict_penalty, mct_score, decision.  Factors are multiplied by family name; the floor comes
    after the caps; the band is that of the rounded score."""
    product = F.lit(1.0)
    for k in sorted(config.EVIDENCE_FAMILIES):
        product = product * (F.lit(1.0) - _weight(F.coalesce(F.col(f"f_{k}"), F.lit(""))))
    has = lambda c: F.array_contains("conflicts", c)
    penalty = F.lit(0.0)
    for c, p in config.CONFLICT_PENALTIES.items():
        penalty = penalty + F.when(has(c), F.lit(p)).otherwise(F.lit(0.0))
    base = rows.select("*", (F.lit(1.0) - product).alias("__pos"), F.least(F.lit(1.0), penalty).alias("__pen"))
    value = F.greatest(F.lit(0.0), F.col("__pos") - F.col("__pen"))
    for c, cap in config.CONFLICT_CAPS.items():
        value = F.least(value, F.when(has(c), F.lit(cap)))  # least skips nulls; value is named once, so plans don't grow by doubling
    several = F.size(F.array_intersect("conflicts", F.array(*map(F.lit, config.IDENTITY_CONFLICTS)))) >= 2
    value = F.least(value, F.when(several, F.lit(config.TWO_CONFLICTS_CAP)))
    floor = F.arrays_overlap("evidence", F.array(*map(F.lit, config.FLOOR_FEATURES))) & ~F.arrays_overlap("conflicts", F.array(*map(F.lit, config.FLOOR_BARRED_BY)))
    value = F.greatest(value, F.when(floor, F.lit(config.FLOOR)))
    own = [c for c in rows.columns if not c.startswith("f_")]
    out = base.select(*own, F.round("__pos", 6).alias("positive_score"), F.round("__pen", 6).alias("conflict_penalty"), F.round(value, 6).alias("mct_score"))
    return out.withColumn("decision", decide(F.col("mct_score")))


def decide(s: Column) -> Column:
    return F.when(s >= config.AUTO_MERGE, "auto_merge").when(s >= config.HUMAN_REVIEW, "human_review").otherwise("leave_separate")


def mark(recs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pair's score follows from its booleans alone.  They are kept as one number a pair (__met, in the first table); families and scores are worked
    out once for each number that occurs (the second table: some hundred rows, 2**21 at most)."""
    rows = evidence(recs, pairs)
    bits = {c: 1 << i for i, c in enumerate(c for c in rows.columns if c not in pairs.columns)}
    met = reduce(Column.bitwiseOR, (F.when(F.col(c), F.lit(b)).otherwise(F.lit(0)) for c, b in bits.items()))
    marked = keep(rows.select(*pairs.columns, met.alias("__met")), "marked")
    kinds = marked.select("__met").distinct().coalesce(1).select("__met", *((F.col("__met").bitwiseAND(F.lit(b)) != 0).alias(c) for c, b in bits.items()))
    return marked, keep(score(families(kinds)), "kinds")


def with_scores(marked: DataFrame, kinds: DataFrame) -> DataFrame:
    """Marked pairs, and whatever else their rows hold, with evidence, conflicts, scores and decision."""
    return marked.join(F.broadcast(kinds), "__met").drop("__met")


def score_pairs(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    return with_scores(*mark(recs, pairs))


def decision_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("mct_score"), 4).alias("mean_score"), F.min("mct_score").alias("min_score"), F.max("mct_score").alias("max_score"))


def event_summary(scored: DataFrame, column: str) -> DataFrame:
    """How many pairs of each decision carry each event of evidence or conflicts."""
    return scored.select("decision", F.explode(column).alias("event")).groupBy("event", "decision").agg(F.count(F.lit(1)).alias("n"))
