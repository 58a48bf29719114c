"""What the queries share: the pipeline's tables as lazy steps, and the same steps as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.operators import blocking, cluster, observe, scoring
from kinmesh.sources import five
from kinmesh.sources import identity_view as view
from kinmesh.storage import keep, table


class Steps:
    """The identity pipeline over the star-schema tables.  A step that several later ones read is written once to the shared folder."""

    verified = "email_role = 'verified_identifier'"

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def identity(self) -> DataFrame:
        return view.identity(self.spark, self.sf_dir)

    @cached_property
    def ids(self) -> DataFrame:
        return self.identity.select("rid", "source", "record_ordinal", "source_record_id")

    @cached_property
    def truth(self) -> DataFrame:
        return self.identity.select("rid", "source", "source_record_id", "person_id")

    @cached_property
    def _fields(self) -> dict[str, dict[str, str]]:
        return {s: {c: c for c in cs} for s, cs in view.VIEW_FIELDS.items()}

    @cached_property
    def obs(self) -> DataFrame:
        return observe.observations(self.identity.drop("person_id"), self._fields, self.verified)

    @cached_property
    def seen(self) -> DataFrame:
        """Every record's distinct valid values, and whether they are verified."""
        return keep(observe.record_values(self.identity.drop("person_id"), self._fields, self.verified), "values")

    @cached_property
    def values(self) -> DataFrame:
        return self.seen.drop("verified")

    @cached_property
    def high(self) -> DataFrame:
        return blocking.rule2_registry(self.values)

    @cached_property
    def keys(self) -> DataFrame:
        return keep(blocking.block_keys(self.values), "keys")

    @cached_property
    def pairs(self) -> DataFrame:
        return keep(blocking.candidate_pairs(self.keys), "pairs")

    @cached_property
    def records(self) -> DataFrame:
        return keep(scoring.records(self.values, None, self.seen.where("verified").select("rid", "value"), self.ids), "records")

    @cached_property
    def marked(self) -> tuple[DataFrame, DataFrame]:
        return scoring.mark(self.records, self.pairs)

    @cached_property
    def scored_plan(self) -> DataFrame:
        return scoring.with_scores(*self.marked)

    @cached_property
    def scored(self) -> DataFrame:
        """The pairs are written with the number of their score; each read looks the score up in a small table."""
        return self.scored_plan

    @cached_property
    def assigned(self) -> DataFrame:
        return keep(cluster.assign(self.ids, self.scored), "assigned")


class SourceSteps(Steps):
    """The same pipeline over a folder of the five declared sources, which carry no truth."""

    verified = five.VERIFIED

    @cached_property
    def identity(self) -> DataFrame:
        return five.records(self.spark, self.sf_dir)

    @cached_property
    def _fields(self) -> dict[str, dict[str, str]]:
        return five.FIELDS


# ---------------------------------------------------------------- SQL

MISSING = """({x} IS NULL OR lower(trim({x})) IN ('', '""', '''''', 'null', 'none'))"""
_EMAIL = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"


def _missing(x: str) -> str:
    return MISSING.format(x=x)


def normalized_sql(concept: str, x: str) -> tuple[str, str, str]:
    """Value, flags (;-joined) and transformation of ASCII text that isn't missing; the value is null where it is invalid."""
    t = f"trim({x})"
    if concept == "email":
        hits = f"regexp_extract_all({t}, '{_EMAIL}')"
        one = f"{hits}[1]"
        bad = f"regexp_matches({one}, '^\\.|\\.@|\\.\\.[^@]*@')"
        how = "single-address extraction + case-fold"
        ok = f"(len({hits}) = 1 AND NOT {bad})"
        return (
            f"CASE WHEN {ok} THEN lower({one}) END",
            f"CASE WHEN len({hits}) > 1 THEN 'multiple_email_candidates' WHEN len({hits}) = 0 THEN 'invalid_email_structure' WHEN {bad} THEN 'invalid_email_local_part' WHEN {one} <> {t} THEN 'email_extracted_from_export_text' ELSE '' END",
            f"CASE WHEN {ok} THEN 'NFKC + single-address extraction + case-fold; dots/plus preserved' ELSE '{how}' END",
        )
    if concept == "phone":
        digits = f"regexp_replace({t}, '[^0-9]', '', 'g')"
        chars = f"(regexp_matches({t}, '^[+0-9\\s().-]+$') AND NOT contains(substr({t}, 2), '+'))"
        size = f"length({digits}) BETWEEN 7 AND 15"
        return (
            f"CASE WHEN {chars} AND {size} THEN CASE WHEN starts_with({t}, '+') THEN '+' || {digits} ELSE {digits} END END",
            f"CASE WHEN NOT {chars} THEN 'invalid_phone_characters' WHEN NOT {size} THEN 'invalid_phone_length' WHEN starts_with({t}, '+') THEN '' ELSE 'country_code_not_explicit' END",
            f"CASE WHEN {chars} AND {size} THEN 'NFKC + safe punctuation removal; country code not inferred' ELSE 'safe punctuation removal; no country inference' END",
        )
    if concept in ("full_name", "city"):
        v = f"lower(regexp_replace({t}, '\\s+', ' ', 'g'))"
        how = "NFKC + primary export text + case-fold + whitespace collapse"
        if concept == "city":
            v, how = f"trim(regexp_replace(regexp_replace({v}, '[-_.]+', ' ', 'g'), '\\s+', ' ', 'g'))", "NFKC + case-fold + safe city punctuation + whitespace collapse"
        digit = f"CASE WHEN regexp_matches({v}, '[0-9]') THEN 'contains_digit' ELSE '' END" if concept == "full_name" else "''"
        return v, digit, f"'{how}'"
    return t, "''", "'NFKC + trim; case preserved'"


def _obs_sql() -> str:
    parts = []
    fields = sorted({c for cs in view.VIEW_FIELDS.values() for c in cs}) + ["source_record_id"]
    for c in fields:
        have = ", ".join(f"'{s}'" for s, cs in view.VIEW_FIELDS.items() if c in cs or c == "source_record_id")
        value, flags, how = normalized_sql(c, c)
        role = "'source_record_key'" if c == "source_record_id" else "email_role" if c == "email" else "'observed_identifier'"
        key = f"lower(trim({c}))" if c == "email" else f"CASE WHEN regexp_matches(trim({c}), '^[+0-9\\s().-]+$') THEN regexp_replace(trim({c}), '[\\s().-]+', '', 'g') ELSE trim({c}) END" if c == "phone" else f"trim({c})"
        m = _missing(c)
        parts.append(
            f"SELECT rid, source, record_ordinal, source_record_id, '{c}' AS raw_field, '{c}' AS canonical_concept, {c} AS raw_value, CASE WHEN {m} THEN NULL ELSE {key} END AS profiling_key, CASE WHEN {m} THEN NULL ELSE {value} END AS normalized_value, CASE WHEN {m} THEN 'missing' WHEN {value} IS NULL THEN 'invalid' ELSE 'valid' END AS normalization_status, CASE WHEN {m} THEN 'missing-token exclusion' ELSE {how} END AS transformation, CASE WHEN {m} THEN '' ELSE {flags} END AS quality_flags, {role} AS evidence_role FROM identity WHERE source IN ({have})"
        )
    return "\nUNION ALL ".join(parts)


_PLACE = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(view.VIEW_SOURCES))
CTES = {
    "identity": f"SELECT CAST(CASE source {_PLACE} END AS BIGINT) * {view.RID_STEP} + record_ordinal AS rid, * FROM ({view.IDENTITY_SQL.format(customer='customer', supplier='supplier', orders='orders', events='events')})",
    "obs": f"SELECT *, coalesce(normalization_status = 'valid' AND normalized_value <> raw_value, false) AS normalization_changed FROM ({_obs_sql()})",
    "vals": "SELECT DISTINCT rid, source, canonical_concept AS concept, normalized_value AS value FROM obs WHERE normalization_status = 'valid' AND normalized_value <> '' AND canonical_concept <> 'source_record_id'",
    "freq": "SELECT concept, value, count(*) AS global_frequency FROM vals GROUP BY ALL",
    "high": "SELECT * FROM freq WHERE global_frequency > 40",
    "derived": r"""
 SELECT 'exact_' || concept AS rule, v.value AS key, rid FROM vals v JOIN freq f USING (concept, value) WHERE global_frequency BETWEEN 2 AND 40 AND concept IN ('email','hashed_email','phone','device_id','account_reference','payment_token','provider_id')
 UNION SELECT 'email_skeleton', replace(regexp_replace(split_part(value, '@', 1), '\+.*$', ''), '.', '') || '@' || split_part(value, '@', 2), rid FROM vals WHERE concept = 'email' AND length(value) - length(replace(value, '@', '')) = 1 AND replace(regexp_replace(split_part(value, '@', 1), '\+.*$', ''), '.', '') <> '' AND split_part(value, '@', 2) <> ''
 UNION SELECT 'email_sha256_bridge', sha256(value), rid FROM vals WHERE concept = 'email'
 UNION SELECT 'phone_suffix_9', right(regexp_replace(value, '[^0-9]', '', 'g'), 9), rid FROM vals WHERE concept = 'phone' AND length(regexp_replace(value, '[^0-9]', '', 'g')) >= 9
 UNION SELECT 'numeric_account_reference', coalesce(nullif(ltrim(value, '0'), ''), '0'), rid FROM vals WHERE concept = 'account_reference' AND regexp_matches(value, '^[0-9]+$')
 UNION SELECT 'name_city', regexp_replace(lower(n.value), '[^a-z0-9]', '', 'g') || chr(31) || regexp_replace(lower(c.value), '[^a-z0-9]', '', 'g'), n.rid FROM vals n JOIN vals c ON n.rid = c.rid AND n.concept = 'full_name' AND c.concept = 'city' WHERE regexp_replace(lower(n.value), '[^a-z0-9]', '', 'g') <> '' AND regexp_replace(lower(c.value), '[^a-z0-9]', '', 'g') <> ''""",
    "keys": "SELECT DISTINCT rule, key, rid FROM derived",
    "blk": "SELECT rule, key, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40",
    "kept": "SELECT k.* FROM keys k JOIN blk USING (rule, key)",
    "pairs": "SELECT a.rid AS l, b.rid AS r, list_sort(list(DISTINCT a.rule)) AS rules FROM kept a JOIN kept b ON a.rule = b.rule AND a.key = b.key AND a.rid < b.rid GROUP BY ALL",
    "own": "SELECT v.* FROM vals v LEFT JOIN high h USING (concept, value) WHERE h.value IS NULL OR concept IN ('full_name', 'city')",
    "recs": r"""
 SELECT i.rid, any_value(i.source) AS source, any_value(i.source_record_id) AS source_record_id,
  coalesce(list(DISTINCT o.value) FILTER (o.concept = 'email'), []) AS email, coalesce(list(DISTINCT o.value) FILTER (o.concept = 'phone'), []) AS phone,
  coalesce(list(DISTINCT o.value) FILTER (o.concept = 'device_id'), []) AS device_id, coalesce(list(DISTINCT o.value) FILTER (o.concept = 'account_reference'), []) AS account_reference,
  coalesce(list(DISTINCT o.value) FILTER (o.concept = 'provider_id'), []) AS provider_id,
  coalesce(list(DISTINCT o.value) FILTER (o.concept = 'email' AND i.email_role = 'verified_identifier'), []) AS verified,
  coalesce(list(DISTINCT replace(regexp_replace(split_part(o.value, '@', 1), '\+.*$', ''), '.', '') || '@' || split_part(o.value, '@', 2)) FILTER (o.concept = 'email'), []) AS skeleton,
  coalesce(list(DISTINCT right(regexp_replace(o.value, '[^0-9]', '', 'g'), 9)) FILTER (o.concept = 'phone' AND length(regexp_replace(o.value, '[^0-9]', '', 'g')) >= 9), []) AS suffix,
  coalesce(list(DISTINCT coalesce(nullif(ltrim(o.value, '0'), ''), '0')) FILTER (o.concept = 'account_reference' AND regexp_matches(o.value, '^[0-9]+$')), []) AS numeric_account,
  coalesce(list(DISTINCT regexp_replace(lower(o.value), '[^a-z0-9]', '', 'g')) FILTER (o.concept = 'full_name'), []) AS names,
  coalesce(list(DISTINCT regexp_replace(lower(o.value), '[^a-z0-9]', '', 'g')) FILTER (o.concept = 'city'), []) AS cities
 FROM identity i LEFT JOIN own o ON i.rid = o.rid GROUP BY i.rid""",
    "evid": """
 SELECT p.l, p.r, p.rules, (a.source = b.source AND a.source_record_id = b.source_record_id) AS same_source_record_id,
  (list_has_any(a.account_reference, b.account_reference) OR list_has_any(a.numeric_account, b.numeric_account)) AS exact_account_reference,
  list_has_any(a.provider_id, b.provider_id) AS exact_provider_id,
  (list_has_any(a.email, b.email) AND list_has_any(list_intersect(a.email, b.email), a.verified || b.verified)) AS exact_verified_email,
  (list_has_any(a.email, b.email) AND NOT list_has_any(list_intersect(a.email, b.email), a.verified || b.verified)) AS exact_email,
  (NOT list_has_any(a.email, b.email) AND list_has_any(a.skeleton, b.skeleton)) AS email_skeleton,
  list_has_any(a.phone, b.phone) AS exact_phone, (NOT list_has_any(a.phone, b.phone) AND list_has_any(a.suffix, b.suffix)) AS phone_suffix_9,
  list_has_any(a.device_id, b.device_id) AS exact_device_id, (list_has_any(a.names, b.names) AND list_has_any(a.cities, b.cities)) AS name_city,
  (len(a.numeric_account) > 0 AND len(b.numeric_account) > 0 AND NOT list_has_any(a.numeric_account, b.numeric_account)) AS account_reference_conflict,
  (len(a.verified) > 0 AND len(b.verified) > 0 AND NOT list_has_any(a.verified, b.verified)) AS verified_email_conflict,
  (len(a.skeleton) > 0 AND len(b.skeleton) > 0 AND NOT list_has_any(a.skeleton, b.skeleton)) AS skeleton_apart,
  (len(a.suffix) > 0 AND len(b.suffix) > 0 AND NOT list_has_any(a.suffix, b.suffix)) AS phone_conflict,
  (len(a.names) > 0 AND len(b.names) > 0 AND NOT list_has_any(a.names, b.names)) AS name_conflict
 FROM pairs p JOIN recs a ON p.l = a.rid JOIN recs b ON p.r = b.rid""",
    "fams": """
 SELECT l, r, rules, CASE WHEN same_source_record_id THEN 'same_source_record_id' END AS f_record, CASE WHEN exact_account_reference THEN 'exact_account_reference' END AS f_account,
  CASE WHEN exact_provider_id THEN 'exact_provider_id' END AS f_provider, CASE WHEN exact_verified_email THEN 'exact_verified_email' WHEN exact_email THEN 'exact_email' WHEN email_skeleton THEN 'email_skeleton' END AS f_email,
  CASE WHEN exact_phone THEN 'exact_phone' WHEN phone_suffix_9 THEN 'phone_suffix_9' END AS f_phone, CASE WHEN exact_device_id THEN 'exact_device_id' END AS f_device, CASE WHEN name_city THEN 'name_city' END AS f_demo,
  account_reference_conflict AS c_account, verified_email_conflict AS c_verified, (skeleton_apart AND NOT verified_email_conflict) AS c_email, phone_conflict AS c_phone, name_conflict AS c_name FROM evid""",
    "raws": """
 SELECT *, 1.0::DOUBLE - (1.0::DOUBLE - CASE WHEN f_account IS NOT NULL THEN 0.97::DOUBLE ELSE 0.0 END) * (1.0::DOUBLE - CASE WHEN f_demo IS NOT NULL THEN 0.64::DOUBLE ELSE 0.0 END) * (1.0::DOUBLE - CASE WHEN f_device IS NOT NULL THEN 0.66::DOUBLE ELSE 0.0 END)
   * (1.0::DOUBLE - CASE f_email WHEN 'exact_verified_email' THEN 0.90::DOUBLE WHEN 'exact_email' THEN 0.82::DOUBLE WHEN 'email_skeleton' THEN 0.72::DOUBLE ELSE 0.0 END) * (1.0::DOUBLE - CASE f_phone WHEN 'exact_phone' THEN 0.80::DOUBLE WHEN 'phone_suffix_9' THEN 0.70::DOUBLE ELSE 0.0 END)
   * (1.0::DOUBLE - CASE WHEN f_provider IS NOT NULL THEN 0.98::DOUBLE ELSE 0.0 END) * (1.0::DOUBLE - CASE WHEN f_record IS NOT NULL THEN 0.99::DOUBLE ELSE 0.0 END) AS pos,
  least(1.0::DOUBLE, CASE WHEN c_account THEN 0.35::DOUBLE ELSE 0.0 END + CASE WHEN c_verified THEN 0.40::DOUBLE ELSE 0.0 END + CASE WHEN c_email THEN 0.18::DOUBLE ELSE 0.0 END + CASE WHEN c_phone THEN 0.16::DOUBLE ELSE 0.0 END + CASE WHEN c_name THEN 0.20::DOUBLE ELSE 0.0 END) AS pen,
  c_account::INT + c_verified::INT + c_email::INT + c_phone::INT + c_name::INT AS n_conflicts FROM fams""",
    "scored": """
 SELECT l, r, rules, list_sort(list_filter([f_record, f_account, f_provider, f_email, f_phone, f_device, f_demo], lambda x: x IS NOT NULL)) AS evidence,
  list_sort(list_filter([CASE WHEN c_account THEN 'account_reference_conflict' END, CASE WHEN c_verified THEN 'verified_email_conflict' END, CASE WHEN c_email THEN 'email_conflict' END, CASE WHEN c_phone THEN 'phone_conflict' END, CASE WHEN c_name THEN 'name_conflict' END], lambda x: x IS NOT NULL)) AS conflicts,
  round(pos, 6) AS positive_score, round(pen, 6) AS conflict_penalty, mct_score, CASE WHEN mct_score >= 0.88 THEN 'auto_merge' WHEN mct_score >= 0.62 THEN 'human_review' ELSE 'leave_separate' END AS decision
 FROM (SELECT *, round(CASE WHEN (f_email IS NOT NULL OR f_phone IS NOT NULL) AND NOT c_account AND NOT c_verified THEN greatest(capped, 0.62) ELSE capped END, 6) AS mct_score
  FROM (SELECT *, least(greatest(0.0, pos - pen), CASE WHEN c_account OR c_verified OR n_conflicts >= 2 THEN 0.61::DOUBLE WHEN c_name THEN 0.87::DOUBLE ELSE 2.0 END) AS capped FROM raws))""",
    "merges": "SELECT l AS a, r AS b FROM scored WHERE decision = 'auto_merge' UNION ALL SELECT r, l FROM scored WHERE decision = 'auto_merge'",
    "reach": "SELECT a, b FROM merges UNION SELECT reach.a, merges.b FROM reach JOIN merges ON reach.b = merges.a",
    "comp": "SELECT i.rid, i.source, i.record_ordinal, i.source_record_id, i.person_id, least(i.rid, coalesce(c.b, i.rid)) AS component FROM identity i LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) c ON i.rid = c.a",
    "assigned": "SELECT *, CAST(n AS INTEGER) AS component_size, CASE WHEN n = 1 THEN 'accepted_singleton' WHEN n <= 12 THEN 'accepted_merged' ELSE 'quarantined_oversized' END AS cluster_status FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM comp)",
    "labelled": "SELECT s.*, a.person_id AS p_l, b.person_id AS p_r, a.person_id = b.person_id AS is_match, least(a.source, b.source) || '+' || greatest(a.source, b.source) AS source_pair FROM scored s JOIN identity a ON s.l = a.rid JOIN identity b ON s.r = b.rid",
    "plinks": "SELECT p_l AS a, p_r AS b FROM labelled WHERE p_l <> p_r UNION SELECT p_r, p_l FROM labelled WHERE p_l <> p_r",
    "preach": "SELECT a, b FROM plinks UNION SELECT preach.a, plinks.b FROM preach JOIN plinks ON preach.b = plinks.a",
    "pcomp": "SELECT p.person_id, least(p.person_id, coalesce(min(r.b), p.person_id)) AS component FROM (SELECT DISTINCT person_id FROM identity) p LEFT JOIN preach r ON p.person_id = r.a GROUP BY p.person_id",
    "parts": f"""SELECT person_id, component, CASE WHEN bucket < 50 THEN 'development' WHEN bucket < 70 THEN 'validation' ELSE 'test' END AS partition FROM pcomp JOIN
 (SELECT component, CAST('0x' || substr(sha256(unhex(hex(encode('{config.PARTITION_SALT}')) || string_agg(printf('%08X', octet_length(encode(person_id))) || hex(encode(person_id)), '' ORDER BY person_id))), 1, 12) AS BIGINT) % 100 AS bucket FROM pcomp GROUP BY component) USING (component)""",
    "parted": "SELECT l.*, partition FROM labelled l JOIN parts ON p_l = person_id",
}
#: Which steps each one reads.
NEEDS = {
    "identity": (), "obs": ("identity",), "vals": ("obs",), "freq": ("vals",), "high": ("freq",), "derived": ("vals", "freq"), "keys": ("derived",), "blk": ("keys",), "kept": ("blk",), "pairs": ("kept",),
    "own": ("high",), "recs": ("own",), "evid": ("pairs", "recs"), "fams": ("evid",), "raws": ("fams",), "scored": ("raws",), "merges": ("scored",), "reach": ("merges",), "comp": ("reach",), "assigned": ("comp",),
    "labelled": ("scored",), "plinks": ("labelled",), "preach": ("plinks",), "pcomp": ("preach",), "parts": ("pcomp",), "parted": ("parts",),
}

#: Steps that a recursion or several others read: evaluated once.
ONCE = {"labelled", "plinks", "pcomp", "parts", "parted"}


def with_steps(sql: str, *steps: str) -> str:
    """sql led by the named steps and all that they read."""
    need: set[str] = set()

    def add(s: str):
        for n in NEEDS[s]:
            add(n)
        need.add(s)

    for s in steps:
        add(s)
    return "WITH RECURSIVE " + ",\n".join(f"{k} AS {'MATERIALIZED ' if k in ONCE else ''}({v})" for k, v in CTES.items() if k in need) + "\n" + sql
