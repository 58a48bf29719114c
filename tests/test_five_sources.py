import csv
import json

import pytest
from test_sources import workbook

from kinmesh import config
from kinmesh.operators import cluster, observe, profile
from kinmesh.queries.base import SourceSteps
from kinmesh.sources import readers
from kinmesh.storage import keep

HOT, PHONE = "hot@example.test", "+999123456789"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """44 records in five formats: one e-mail on 41 of them, one phone on 40, a name with a line break, one that says None, odd spellings."""
    at = tmp_path_factory.mktemp("five")
    app = [dict(account_id=f"{i:03d}", email="  HOT@Example.test " if i == 0 else HOT, phone="+999 (123) 456-789" if i == 1 else PHONE, first_name="Ada\nsecond line" if i == 2 else "None" if i == 3 else f"Ada{i}", last_name="King", dob="2000-12-31", device_id=f"DEV-{i}", device_type="phone", signup_ts="2026-01-01 10:00:00", country="IN", city="Metro City", channel="web", engagement_count="3") for i in range(20)]
    store = [dict(customer_id=f"C{i}", app_account_ref=str(i) if i < 20 else "", customer_email_address=HOT, contact_no=PHONE if i < 20 else "12+34", first=f"Bo{i}", last="Straße", dob="31-12-2000", device="", device_type="", line1="1 Road", line2="", city="metro-city", postcode="AB 1", country="U.S.", updated_ts="", channel="") for i in range(21)]
    for name, rows in (("app_users", app), ("store_customers", store)):
        with open(at / f"{name}.csv", "w", newline="", encoding="utf-8-sig") as f:
            out = csv.DictWriter(f, list(rows[0]))
            out.writeheader()
            out.writerows(rows)
    (at / "ticketing.jl").write_text(json.dumps(dict(booking_id="B1", account_id="000", full_name="Ada King", email="t@x.test", phone=None, device_id="DEV-0", city="Élodie", event_ts="", created_ts="", channel="")) + "\n\n")
    workbook(at / "subscriptions.xlsx", {"notes": [["n"]], "subscriptions": [["title"], ["subscription_id", "email", "subscriber_name", "billing_name", "payment_token", "country"], ["S1", "s@x.test", "Cy Lo", "Cy  Lo", "tok", "Mars"]]})
    (at / "social_logins.json").write_text(json.dumps([dict(provider="google", login_ts="", channel="", engagement_count=1, identity_payload=dict(provider_id="g1", verified_email="s@x.test", device_id="DEV-0"))]))
    return str(at)


def test_end_to_end(spark, folder):
    s = SourceSteps(spark, folder)
    s.obs = keep(s.obs, "obs")
    obs = s.obs.collect()
    assert len(obs) == 494 and len({o.rid for o in obs}) == 44
    count = {k: sum(o.source == k for o in obs) for k in config.SOURCES}
    assert count == {"app_users": 200, "store_customers": 273, "ticketing": 7, "subscriptions": 6, "social_logins": 8}
    of = {(o.source, o.record_ordinal, o.raw_field): o for o in obs}
    assert of["app_users", 1, "email"].normalized_value == HOT and of["app_users", 1, "email"].normalization_changed
    assert of["app_users", 3, "first_name"].quality_flags == ["trailing_multiline_annotation_removed"] and of["app_users", 3, "first_name"].normalized_value == "ada"
    assert of["app_users", 4, "first_name"].normalization_status == "missing" and of["store_customers", 21, "contact_no"].normalization_status == "invalid"
    assert of["store_customers", 1, "last"].normalized_value == "strasse" and of["ticketing", 1, "city"].normalized_value == "élodie" and of["subscriptions", 1, "country"].quality_flags == ["unknown_country_alias"]
    assert of["social_logins", 1, "identity_payload.verified_email"].evidence_role == "verified_identifier"
    high = {(r.concept, r.value): r.global_frequency for r in s.high.collect()}
    assert {k: n for k, n in high.items() if k[0] in ("email", "phone")} == {("email", HOT): 41}  # the phone is on forty
    assert s.values.where("concept = 'full_name' AND value = 'cy lo'").count() == 1  # two fields, one value
    pairs = {(r.l, r.r): r.rules for r in s.pairs.collect()}
    assert sum("exact_phone" in rules for rules in pairs.values()) == 40 * 39 // 2 and not any("exact_email" in rules and len(rules) > 9 for rules in pairs.values())
    scored = {(r.l, r.r): r for r in s.scored.collect()}
    mail = next(r for (a, b), r in scored.items() if a >> 40 == 3 and b >> 40 == 4)
    assert "exact_verified_email" in mail.evidence and mail.decision == "auto_merge"
    assert cluster.size_distribution(s.assigned).agg({"records": "sum"}).first()[0] == 44
    assert observe.field_statistics(s.obs).agg({"total": "sum"}).first()[0] == 494 and profile.column_profile(s.obs).count() == 9 + 12 + 6 + 5 + 7 + 5


def test_ordinals_follow_the_file(spark, tmp_path):
    """Also in a file that is read in many splits."""
    rows = [dict(booking_id=f"B{i}", account_id="1", full_name="x", email="e", phone="p", device_id="d", city="c" * (i % 50)) for i in range(5000)]
    (tmp_path / "ticketing.jl").write_text("\n".join(map(json.dumps, rows)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = readers.read_source(spark, str(tmp_path), "ticketing")
        got = {r.record_ordinal: r.source_record_id for r in df.select("record_ordinal", "source_record_id").collect()}
        splits = spark.read.json(str(tmp_path / "ticketing.jl")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 3 and got == {i + 1: f"B{i}" for i in range(5000)}


def test_blank_ids_fail(spark, tmp_path):
    (tmp_path / "ticketing.jl").write_text(json.dumps(dict(booking_id=" ", account_id="1", full_name="x", email="e", phone="p", device_id="d", city="c")))
    with pytest.raises(Exception, match="blank record id"):
        readers.read_source(spark, str(tmp_path), "ticketing").collect()
