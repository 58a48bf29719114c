"""A deterministic identity view over the star-schema tables, which carry no identity columns of their own.  Integer
arithmetic and concatenation only, so every engine agrees on it; value frequencies fall on both sides of the
frequency threshold at every scale.  person_id is truth: it never enters blocking or scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmesh.storage import table

#: Order of the sources; record numbers (rid) follow it.
VIEW_SOURCES = ("app_users", "store_customers", "ticketing", "social_logins")
#: Which concepts each source of the view has.
VIEW_FIELDS = {
    "app_users": ("email", "phone", "device_id", "account_reference", "full_name", "city"),
    "store_customers": ("email", "phone", "device_id", "account_reference", "full_name", "city"),
    "ticketing": ("email", "phone", "account_reference"),
    "social_logins": ("email", "device_id", "provider_id"),
}
VIEW_CONCEPTS = ("email", "phone", "device_id", "account_reference", "provider_id", "full_name", "city")
#: rid = place of the source * RID_STEP + ordinal: the global order without a global sort.
RID_STEP = 1 << 40

COLUMNS = "source, record_ordinal, source_record_id, email, email_role, phone, device_id, account_reference, provider_id, full_name, city, person_id"

IDENTITY_SQL = """
SELECT 'app_users' AS source, c_custkey + 1 AS record_ordinal, CAST(c_custkey AS STRING) AS source_record_id,
 concat('User.', CAST(CAST(floor(c_custkey/2) AS BIGINT) AS STRING), CASE WHEN c_custkey % 2 = 1 THEN '+alt' ELSE '' END, '@Example.test') AS email,
 'observed_identifier' AS email_role,
 concat('+999 ', lpad(CAST(CAST(floor(c_custkey/3) AS BIGINT) AS STRING), 9, '0')) AS phone,
 concat('DEV-', CAST(CAST(floor(c_custkey/4) AS BIGINT) AS STRING)) AS device_id,
 CAST(c_custkey AS STRING) AS account_reference, CAST(NULL AS STRING) AS provider_id,
 c_name AS full_name, concat('Nation-', CAST(c_nationkey AS STRING)) AS city,
 concat('P', CAST(CAST(floor(c_custkey/2) AS BIGINT) AS STRING)) AS person_id FROM {customer}
UNION ALL
SELECT 'store_customers', s_suppkey + 1, concat('SC', CAST(s_suppkey AS STRING)),
 concat('user', CAST(CAST(floor(s_suppkey/2) AS BIGINT) AS STRING), '@example.test'), 'observed_identifier',
 concat('0', lpad(CAST(CAST(floor(s_suppkey/3) AS BIGINT) AS STRING), 9, '0')),
 concat('DEV-', CAST(CAST(floor(s_suppkey/4) AS BIGINT) AS STRING)),
 lpad(CAST(s_suppkey AS STRING), 9, '0'), CAST(NULL AS STRING), s_name, concat('Nation ', CAST(s_nationkey AS STRING)),
 concat('P', CAST(CAST(floor(s_suppkey/2) AS BIGINT) AS STRING)) FROM {supplier}
UNION ALL
SELECT 'ticketing', o_orderkey + 1, concat('B', CAST(o_orderkey AS STRING)),
 CASE WHEN o_orderkey % 5 = 0 THEN 'bookings@events.example' ELSE concat('t', CAST(o_orderkey AS STRING), '@ticket.example.test') END, 'observed_identifier',
 CASE WHEN o_orderkey % 10 = 0 THEN '0000000000' ELSE NULL END,
 CAST(NULL AS STRING), lpad(CAST(o_custkey AS STRING), 9, '0'), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
 concat('P', CAST(CAST(floor(o_custkey/2) AS BIGINT) AS STRING)) FROM {orders}
UNION ALL
SELECT 'social_logins', event_id + 1, concat('google_', CAST(event_id AS STRING)),
 CASE WHEN event_type = 'signup' THEN concat('user', CAST(CAST(floor(user_id/2) AS BIGINT) AS STRING), '@example.test') ELSE NULL END, 'verified_identifier',
 CAST(NULL AS STRING), concat('DEV-', CAST(CAST(floor(user_id/4) AS BIGINT) AS STRING)), CAST(NULL AS STRING),
 concat('prov_', CAST(CAST(floor(event_id/3) AS BIGINT) AS STRING)), CAST(NULL AS STRING), CAST(NULL AS STRING),
 concat('P', CAST(CAST(floor(user_id/2) AS BIGINT) AS STRING)) FROM {events}
"""


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, source, record_ordinal, source_record_id, the concepts' raw values, email_role and person_id."""
    view = spark.sql(IDENTITY_SQL, **{t: table(spark, sf_dir, t) for t in ("customer", "supplier", "orders", "events")})
    place = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(VIEW_SOURCES))
    return view.selectExpr(f"CAST(CASE source {place} END AS BIGINT) * {RID_STEP} + record_ordinal AS rid", "*")
