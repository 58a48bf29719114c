"""Queries of data-quality audits over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinmesh.functions import text
from kinmesh.operators import audit, profile
from kinmesh.operators.graph import components as graph_components
from kinmesh.operators.graph import star_edges
from kinmesh.queries.registry import registrar
from kinmesh.sources.identity_view import VIEW_CONCEPTS, VIEW_FIELDS

query, QUERIES, ORACLES = registrar()


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS extra_rows, count(*) AS groups FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def exact_duplicates(s):
    return audit.exact_duplicates(s.table("documents"), ["text"])


@query("SELECT event_type, count(*) AS total, count_if(value IS NULL) AS value_missing, count_if(props IS NULL OR lower(trim(props)) IN ('', 'null', 'none')) AS props_missing FROM events GROUP BY ALL")
def missingness(s):
    return audit.missingness(s.table("events"), ["event_type"], ["value", "props"])


@query("SELECT count(*) AS orphans, (SELECT count(*) FROM orders) AS total FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)")
def orphans(s):
    return audit.orphans(s.table("orders"), s.table("customer"), "o_custkey", "c_custkey")


@query("SELECT 'segment' AS category, count(DISTINCT c_mktsegment) AS variants FROM customer UNION ALL SELECT 'priority', count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events")
def category_variants(s):
    return audit.category_variants({"segment": (s.table("customer"), "c_mktsegment"), "priority": (s.table("orders"), "o_orderpriority"), "event_type": (s.table("events"), "event_type")})


@query("SELECT count_if(contains(text, ',')) AS comma, count_if(contains(text, '\"')) AS quote, count_if(contains(text, chr(10))) AS line_break, count_if(regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')) AS astral, count_if(regexp_matches(text, '[\\x{0900}-\\x{097F}]')) AS devanagari FROM documents")
def text_features(s):
    return audit.text_features(s.table("documents"), "text")


@query("SELECT user_id, count_if(ts < prior) AS inversions FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS prior FROM events) GROUP BY ALL")
def out_of_order(s):
    return audit.inversions(s.table("events"), "user_id", "event_id", "ts")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 0 UNION SELECT o_orderkey FROM orders WHERE o_totalprice >= 3 * (SELECT median(o_totalprice) FROM orders) UNION SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def impossible_values(s):
    return audit.impossible_orders(s.table("orders"))


_DOC_EMAIL = r"[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"


@query(
    f"SELECT doc_id, CAST(len(h) AS INTEGER) AS n_hits, CASE WHEN len(h) = 1 AND NOT regexp_matches(h[1], '^\\.|\\.@|\\.\\.[^@]*@') THEN lower(h[1]) END AS email FROM (SELECT doc_id, regexp_extract_all(text, '{_DOC_EMAIL}') AS h FROM documents)"
)
def email_from_documents(s):
    """Exactly-one extraction over real texts."""
    hits = F.regexp_extract_all("text", F.lit(text.EMAIL), F.lit(0))
    docs, plain = s.table("documents"), text.is_plain("text", "email")
    text.register(s.spark)
    of = lambda rows, easy: rows.select("doc_id", F.size(hits).alias("n_hits"), F.expr(f"({text.normalized('text', 'email', easy)}).value").alias("email"))
    return of(docs.where(plain), True).unionByName(of(docs.where(f"NOT {plain}"), False))


@query("SELECT event_id, ts, CASE format WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN strftime(ts, '%d-%m-%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%Y/%m/%d %H:%M:%S') ELSE CAST(epoch_ms(ts) AS VARCHAR) END AS raw, ['iso', 'local', 'day_first', 'slashes', 'epoch_ms'][format + 1] AS label, ts AS parsed FROM (SELECT event_id, date_trunc('second', ts) AS ts, event_id % 5 AS format FROM events)")
def timestamp_formats(s):
    """Each event's time rendered in one of five formats, told apart and read back."""
    from kinmesh.functions import times

    ts = F.date_trunc("second", "ts")
    local = F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd HH:mm:ss")
    raw = F.element_at(F.array(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), local, F.date_format(ts, "dd-MM-yyyy HH:mm:ss"), F.date_format(ts, "yyyy/MM/dd HH:mm:ss"), F.unix_millis(ts.cast("timestamp")).cast("string")), (F.col("event_id") % 5 + 1).cast("int"))
    rows = s.table("events").select("event_id", ts.alias("ts"), raw.alias("raw"))
    return rows.withColumns({"label": times.format_of(F.col("raw")), "parsed": times.parse(F.col("raw"))})


@query()
def token_components(s):
    """Orders joined by shared tokens; star edges keep a token's work linear.  Every order is a node, which is too much for recursive SQL: checked against
    a brute force in the tests."""
    o = s.table("orders")
    members = o.select(F.concat(F.lit("d"), F.col("o_custkey").cast("string")).alias("token"), F.col("o_orderkey").alias("node")).union(o.select(F.concat(F.lit("p"), F.floor(F.col("o_custkey") / 2).cast("string")), "o_orderkey"))
    return graph_components(o.select(F.col("o_orderkey").alias("node")).distinct(), star_edges(members))


@query("SELECT CAST(sum(CASE WHEN n > 40 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN n <= 40 THEN n * (n - 1) // 2 ELSE 0 END) AS BIGINT) AS remaining FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def naive_pair_incidences(s):
    n = s.table("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select("n", text.potential_pairs(F.col("n")).alias("p"))
    return n.agg(F.coalesce(F.sum(F.when(F.col("n") > 40, F.col("p"))), F.lit(0)).alias("removed"), F.coalesce(F.sum(F.when(F.col("n") <= 40, F.col("p"))), F.lit(0)).alias("remaining"))


# ---------------------------------------------------------------- identity view: scalar rules and audits

_ABSENT = "({x} IS NULL OR lower(trim({x})) IN ('', 'null', 'none'))"


@query(
    "SELECT DISTINCT rid, unnest(list_filter([" + ", ".join(f"CASE WHEN NOT {_ABSENT.format(x=c)} THEN '{k}:' || {v} END" for k, c, v in (("email", "email", "lower(trim(email))"), ("device", "device_id", "trim(device_id)"), ("account", "account_reference", "trim(account_reference)"))) + f", CASE WHEN NOT {_ABSENT.format(x='full_name')} AND NOT {_ABSENT.format(x='city')} THEN 'name_city:' || trim(regexp_replace(lower(full_name), '[^a-z0-9]+', ' ', 'g')) || '|' || trim(regexp_replace(lower(city), '[^a-z0-9]+', ' ', 'g')) END], lambda x: x IS NOT NULL)) AS token FROM identity",
    "identity",
)
def naive_tokens(s):
    return audit.record_tokens(s.identity, {"email": "email", "device": "device_id", "account": "account_reference"}, ("full_name",), "city")


@query("SELECT 'email:' || e AS token, n, CASE WHEN e = 'bookings@events.example' THEN 'poison' ELSE 'frequency' END AS why FROM (SELECT lower(trim(email)) AS e, count(*) AS n FROM identity WHERE email IS NOT NULL GROUP BY ALL) WHERE n > 40 OR e = 'bookings@events.example'", "identity")
def worthless_tokens(s):
    return audit.worthless_tokens(audit.record_tokens(s.identity, {"email": "email"}), ("email:bookings@events.example",))


@query("SELECT event_type, array_to_string(list_sort(json_keys(props)), ',') AS shape, count(*) AS n FROM events GROUP BY ALL")
def payload_shapes(s):
    return audit.payload_shapes(s.table("events"), "event_type", "props")


@query("SELECT user_id, n, round(span, 3) AS span, round(span / nullif(n - 1, 0), 3) AS mean_step, most FROM (SELECT user_id, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts)))::DOUBLE / 1000000 AS span, max(value) AS most FROM events GROUP BY ALL)")
def bot_behaviour(s):
    return audit.behaviour(s.table("events"), "user_id", "ts", "value")


@query("SELECT count(*) AS people, CAST(sum(f) AS BIGINT) AS flagged, round(sum(f)::DOUBLE / count(*), 6) AS rate FROM (SELECT user_id, max(CAST(event_type = 'error' AS INTEGER)) AS f FROM events GROUP BY user_id)")
def flagged_people(s):
    return audit.share_of_people(s.table("events"), "user_id", F.col("event_type") == "error")


@query("SELECT count(*) AS total, count_if(epoch_us(ts) - epoch_us(o_orderdate) > 9 * 86400000000) AS late, count_if(epoch_us(ts) < epoch_us(o_orderdate)) AS early FROM orders JOIN events ON o_orderkey = event_id WHERE ts IS NOT NULL AND o_orderdate IS NOT NULL")
def late_arrivals(s):
    """Events as arrivals of the orders of their number."""
    return audit.late_arrivals(s.table("orders").join(s.table("events"), F.col("o_orderkey") == F.col("event_id")), "o_orderdate", "ts")


@query("SELECT 'day_first' AS format, count(*) AS n, 0::BIGINT AS unreadable, count_if(day(ts) <= 12 AND day(ts) <> month(ts)) AS ambiguous FROM events")
def timestamp_ambiguity(s):
    """Event times written day first: how many could be read month first."""
    return audit.timestamp_counts(s.table("events").select(F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("raw")), "raw")


@query("SELECT round(a, 6) AS share, round(b, 6) AS other_share, round(2 * asin(sqrt(a)) - 2 * asin(sqrt(b)), 5) AS effect FROM (SELECT count_if(email IS NULL AND source = 'social_logins')::DOUBLE / count_if(source = 'social_logins') AS a, count_if(email IS NULL AND source = 'app_users')::DOUBLE / count_if(source = 'app_users') AS b FROM identity)", "identity")
def missingness_effect(s):
    return audit.missing_effect(s.identity, "email", "source", "social_logins", "app_users")


@query("SELECT e.* EXCLUDE (gap, props) FROM (SELECT *, epoch_us(date_trunc('second', ts)) // 1000000 - lag(epoch_us(date_trunc('second', ts)) // 1000000) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events) e WHERE gap BETWEEN 1 AND 60")
def near_duplicates(s):
    """Events that repeat one of their user and type a minute earlier at most."""
    return audit.near_duplicates(s.table("events").drop("props"), "user_id", "ts", ["event_type"]).drop("gap")


# ---------------------------------------------------------------- scalar rules whose concepts the view lacks, over the tables' own values

def _rule(name, table, key, raw, sql_raw, concept, sql_value, sql_status, sql_flags):
    @query(f"SELECT k, {sql_value} AS value, {sql_status} AS status, {sql_flags} AS flags FROM (SELECT {key} AS k, {sql_raw} AS x FROM {table})")
    def run(s):
        text.register(s.spark)
        rows = s.table(table).select(F.col(key).alias("k"), F.expr(raw).alias("x"))
        of = lambda some, easy: some.select("k", F.expr(text.normalized("x", concept, easy)).alias("n")).select("k", "n.value", "n.status", F.array_join("n.flags", ";").alias("flags"))
        plain = text.is_plain("x", concept)
        return of(rows.where(plain), True).unionByName(of(rows.where(f"NOT {plain}"), False))

    QUERIES[name], ORACLES[name] = QUERIES.pop("run"), ORACLES.pop("run")


_rule("normalize_date", "orders", "o_orderkey", "date_format(o_orderdate, 'd-M-yyyy')", "CAST(day(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR)", "date_of_birth", "strftime(strptime(x, '%d-%m-%Y'), '%Y-%m-%d')", "'valid'", "''")
_rule("normalize_hash", "customer", "c_custkey", "upper(sha2(c_name, 256))", "upper(sha256(c_name))", "hashed_email", "lower(x)", "'valid'", "''")
_rule("normalize_postcode", "customer", "c_custkey", "c_name", "c_name", "postcode", "CASE WHEN regexp_matches(x, '^[A-Za-z0-9_\\s-]+$') THEN upper(regexp_replace(x, '[\\s-]+', '', 'g')) END", "CASE WHEN regexp_matches(x, '^[A-Za-z0-9_\\s-]+$') THEN 'valid' ELSE 'invalid' END", "CASE WHEN regexp_matches(x, '^[A-Za-z0-9_\\s-]+$') THEN '' ELSE 'invalid_postcode_characters' END")
_COUNTRY = "CASE regexp_replace(upper(x), '[^A-Z0-9]+', '', 'g') WHEN 'INDIA' THEN 'IN' WHEN 'UNITEDSTATES' THEN 'US' WHEN 'UNITEDKINGDOM' THEN 'GB' END"
_rule("normalize_country", "nation", "n_nationkey", "n_name", "n_name", "country", _COUNTRY, f"CASE WHEN {_COUNTRY} IS NULL THEN 'invalid' ELSE 'valid' END", f"CASE WHEN {_COUNTRY} IS NULL THEN 'unknown_country_alias' ELSE '' END")


# ---------------------------------------------------------------- traffic signals

_WINDOW = "(SELECT max(ts) AS stop FROM (SELECT ts, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS n, count(*) OVER () AS total FROM events) WHERE n >= least(3, ceil(total * 0.01)))"


@query(f"SELECT event_id, CASE WHEN contains(lower(props), 'error') OR event_type = 'error' THEN 'qa' WHEN ts BETWEEN stop - INTERVAL 608 SECONDS AND stop + INTERVAL 8 SECONDS AND value <= 4 THEN 'automation' ELSE 'none' END AS policy FROM events, {_WINDOW} w")
def traffic_signals(s):
    """Events as logins: inside the latest dense window (of three, or 1 % of all if that is less), with little engagement."""
    from kinmesh.operators import business

    e = s.table("events").withColumns({"source": F.lit("social_logins"), "engagement_count": F.col("value").cast("string"), "provider": F.lit("google")})
    total = F.count(F.lit(1))
    least = int(e.agg(F.least(F.lit(3), F.ceil(total * business.config.WINDOW_FRACTION)).alias("n")).first().n)
    w = business.dense_windows(e.select("source", "ts"), least=least).select("source", F.col("window_start").alias("a"), F.col("window_end").alias("b"))
    rows = e.join(F.broadcast(w), "source", "left")  # a row a source
    auto = business.automation_signal("social_logins", F.col("ts"), F.col("a"), F.col("b"), F.col)
    qa = F.lower("props").contains("error") | (F.col("event_type") == "error")
    return rows.select("event_id", business.record_policy(qa, auto).alias("policy"))


@query("SELECT source, count(*) AS records, count_if(p = 'qa') AS qa, count_if(p = 'automation') AS automation, count_if(p = 'none') AS people, round(count_if(p = 'none')::DOUBLE / count(*), 6) AS people_share FROM (SELECT source, CASE WHEN source = 'social_logins' AND email IS NULL THEN 'qa' WHEN source = 'ticketing' AND email = 'bookings@events.example' THEN 'automation' ELSE 'none' END AS p FROM identity) GROUP BY source", "identity")
def traffic_summary(s):
    from kinmesh.operators import business

    qa, auto = (F.col("source") == "social_logins") & F.col("email").isNull(), (F.col("source") == "ticketing") & (F.col("email") == "bookings@events.example")
    return business.traffic_summary(s.identity.select("source", business.record_policy(qa, auto).alias("policy")))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{c}', '{'available' if c in cs else 'unavailable'}')" for s, cs in VIEW_FIELDS.items() for c in VIEW_CONCEPTS) + ") t(source, concept, state)")
def schema_availability(s):
    rows = profile.availability({n: {c: c for c in cs} for n, cs in VIEW_FIELDS.items()}, VIEW_CONCEPTS)
    return s.spark.createDataFrame(rows, "source string, concept string, state string")


@query("SELECT flag, n FROM (SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(quality_flags, ';')) AS flag FROM obs WHERE quality_flags <> '') GROUP BY ALL) ORDER BY n DESC, flag LIMIT 10", "obs")
def top_issues(s):
    """The ten most frequent quality flags: a top list, as reports show it."""
    return s.obs.select(F.explode("quality_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "flag").limit(10)
