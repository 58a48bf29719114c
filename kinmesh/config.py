"""Fixed values of the identity pipeline, and the checks that hold between them.  Thresholds are contracts, never tuned."""

from __future__ import annotations

RULE2_THRESHOLD = 40
BLOCK_MIN, BLOCK_MAX = 2, 40
AUTO_MERGE, HUMAN_REVIEW = 0.88, 0.62
COMPONENT_MAX = 12

# Concepts and which sources have them under which names.
CONCEPTS = (
    "source_record_id", "email", "hashed_email", "phone", "first_name", "last_name", "full_name", "date_of_birth", "device_id",
    "account_reference", "payment_token", "address_line1", "address_line2", "city", "postcode", "country", "provider_id",
)
EXACT_CONCEPTS = ("email", "hashed_email", "phone", "device_id", "account_reference", "payment_token", "provider_id")
SOURCES = {
    "app_users": {
        "format": "csv",
        "path": "app_users.csv",
        "record_id": "account_id",
        "fields": {"account_id": "account_reference", "email": "email", "phone": "phone", "first_name": "first_name", "last_name": "last_name", "dob": "date_of_birth", "device_id": "device_id", "city": "city", "country": "country"},
    },
    "store_customers": {
        "format": "csv",
        "path": "store_customers.csv",
        "record_id": "customer_id",
        "fields": {"app_account_ref": "account_reference", "customer_email_address": "email", "contact_no": "phone", "first": "first_name", "last": "last_name", "dob": "date_of_birth", "device": "device_id", "line1": "address_line1", "line2": "address_line2", "city": "city", "postcode": "postcode", "country": "country"},
    },
    "ticketing": {
        "format": "jsonl",
        "path": "ticketing.jl",
        "record_id": "booking_id",
        "fields": {"account_id": "account_reference", "full_name": "full_name", "email": "email", "phone": "phone", "device_id": "device_id", "city": "city"},
    },
    "subscriptions": {
        "format": "excel",
        "path": "subscriptions.xlsx",
        "sheet": "subscriptions",
        "marker": "subscription_id",
        "record_id": "subscription_id",
        "fields": {"email": "email", "subscriber_name": "full_name", "billing_name": "full_name", "payment_token": "payment_token", "country": "country"},
    },
    "social_logins": {
        "format": "nested_json",
        "path": "social_logins.json",
        "record_id": "identity_payload.provider_id",
        "fields": {"identity_payload.verified_email": "email", "identity_payload.hashed_email": "hashed_email", "identity_payload.display_name": "full_name", "identity_payload.provider_id": "provider_id", "identity_payload.phone": "phone", "identity_payload.device_id": "device_id", "identity_payload.city": "city"},
    },
}

# Normalization.
MISSING_TOKENS = ("", '""', "''", "null", "none")
PHONE_DIGITS = (7, 15)
REFERENCE_DATE = "2026-04-03"
MAX_AGE = 120
COUNTRY_ALIASES = {
    "IN": "IN", "IND": "IN", "INDIA": "IN", "US": "US", "USA": "US", "UNITEDSTATES": "US", "GB": "GB", "GBR": "GB", "UK": "GB",
    "UNITEDKINGDOM": "GB", "AU": "AU", "AUS": "AU", "AUSTRALIA": "AU",
}
STRATEGY = {
    "source_record_id": "identifier", "email": "email", "hashed_email": "sha256_hash", "phone": "phone", "first_name": "name", "last_name": "name",
    "full_name": "name", "date_of_birth": "date_of_birth", "device_id": "identifier", "account_reference": "identifier", "payment_token": "identifier",
    "address_line1": "address", "address_line2": "address", "city": "city", "postcode": "postcode", "country": "country", "provider_id": "identifier",
}

# Scoring.
EVIDENCE_WEIGHTS = {
    "same_source_record_id": 0.99, "exact_account_reference": 0.97, "exact_provider_id": 0.98, "exact_verified_email": 0.90, "exact_email": 0.82,
    "email_sha256_bridge": 0.82, "email_skeleton": 0.72, "exact_phone": 0.80, "phone_suffix_9": 0.70, "exact_device_id": 0.66,
    "exact_payment_token": 0.55, "name_city": 0.64, "name_date_of_birth": 0.74, "name_postcode": 0.62,
}
EVIDENCE_FAMILIES = {
    "record_key": ("same_source_record_id",),
    "account": ("exact_account_reference",),
    "provider": ("exact_provider_id",),
    "email": ("exact_verified_email", "exact_email", "email_sha256_bridge", "email_skeleton"),
    "phone": ("exact_phone", "phone_suffix_9"),
    "device": ("exact_device_id",),
    "payment": ("exact_payment_token",),
    "demographics": ("name_date_of_birth", "name_city", "name_postcode"),
}
CONFLICT_PENALTIES = {
    "account_reference_conflict": 0.35, "verified_email_conflict": 0.40, "email_conflict": 0.18, "phone_conflict": 0.16, "date_of_birth_conflict": 0.28,
    "name_conflict": 0.20, "country_conflict": 0.08, "shared_email_payment_household_risk": 0.0,
}
CONFLICT_CAPS = {"account_reference_conflict": 0.61, "verified_email_conflict": 0.61, "date_of_birth_conflict": 0.87, "name_conflict": 0.87, "shared_email_payment_household_risk": 0.87}
TWO_CONFLICTS_CAP = 0.61
IDENTITY_CONFLICTS = ("account_reference_conflict", "verified_email_conflict", "email_conflict", "phone_conflict", "date_of_birth_conflict", "name_conflict")
FLOOR = 0.62
FLOOR_FEATURES = ("exact_verified_email", "exact_email", "email_sha256_bridge", "email_skeleton", "exact_phone", "phone_suffix_9")
FLOOR_BARRED_BY = ("account_reference_conflict", "verified_email_conflict")

# Evaluation and models.
PARTITIONS = {"development": (0, 50), "validation": (50, 70), "test": (70, 100)}
PARTITION_SALT = "person-component-split-v1"
JEFFREYS = 0.5
LOGISTIC_BASE = (
    "conflict:account_reference_conflict", "conflict:date_of_birth_conflict", "conflict:email_conflict", "conflict:name_conflict", "conflict:phone_conflict",
    "conflict:shared_email_payment_household_risk", "conflict:verified_email_conflict", "evidence:email_skeleton", "evidence:exact_account_reference",
    "evidence:exact_device_id", "evidence:exact_email", "evidence:exact_payment_token", "evidence:exact_phone", "evidence:exact_provider_id",
    "evidence:exact_verified_email", "evidence:name_city", "evidence:name_date_of_birth", "evidence:phone_suffix_9", "evidence:same_source_record_id",
)
L2_STRENGTHS = (0.0001, 0.001, 0.01, 0.1)
ADAM = {"epochs": 40, "batch": 8192, "rate": 0.03, "beta1": 0.9, "beta2": 0.999, "epsilon": 1e-8}

# Business estimate.
WINDOW_SECONDS, WINDOW_TOLERANCE, WINDOW_FRACTION = 600, 8, 0.01
SCORE_BINS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.62, 0.7, 0.8, 0.84, 0.86, 0.88)
SIMULATIONS, SIMULATION_SEED = 500, 20260902
QA_DOMAINS, QA_NAMES = ("staff.test",), ("load-test",)
AUTOMATION = {
    "app_users": {"time": "signup_ts", "engagement": 6, "missing": ("phone", "dob")},
    "store_customers": {"time": "updated_ts", "missing": ("app_account_ref", "contact_no", "dob")},
    "ticketing": {"time": "created_ts", "other_time": "event_ts", "delay": 68, "missing": ("account_id", "phone")},
    "subscriptions": {"time": "start_date", "missing": ()},
    "social_logins": {"time": "login_ts", "engagement": 4, "values": {"provider": ("google",)}, "missing": ()},
}


class ConfigError(ValueError):
    pass


def check() -> None:
    """Families share out all features, weights and penalties lie in [0, 1], sources use known concepts, strategies cover all."""
    features = [f for fs in EVIDENCE_FAMILIES.values() for f in fs]
    if sorted(features) != sorted(EVIDENCE_WEIGHTS):
        raise ConfigError("evidence families don't share out the features")
    for name, values in (("weight", EVIDENCE_WEIGHTS), ("penalty", CONFLICT_PENALTIES), ("cap", CONFLICT_CAPS)):
        if bad := [k for k, v in values.items() if not 0 <= v <= 1]:
            raise ConfigError(f"{name} outside [0, 1]: {bad}")
    if set(STRATEGY) != set(CONCEPTS):
        raise ConfigError("strategies don't cover the concepts")
    if not set(CONFLICT_CAPS) <= set(CONFLICT_PENALTIES) or not set(IDENTITY_CONFLICTS) <= set(CONFLICT_PENALTIES):
        raise ConfigError("unknown conflict")
    for source, m in SOURCES.items():
        if bad := set(m["fields"].values()) - set(CONCEPTS):
            raise ConfigError(f"{source} maps to unknown concepts {bad}")
    if not 0 < HUMAN_REVIEW < AUTO_MERGE <= 1 or list(SCORE_BINS) != sorted(set(SCORE_BINS)):
        raise ConfigError("thresholds or bins out of order")
    if list(LOGISTIC_BASE) != sorted(set(LOGISTIC_BASE)) or any(e.split(":")[0] not in ("evidence", "conflict") for e in LOGISTIC_BASE):
        raise ConfigError("base events must be sorted, unique and of a kind")
    if list(L2_STRENGTHS) != sorted(set(L2_STRENGTHS)) or min(L2_STRENGTHS) <= 0 or not 0 < ADAM["beta1"] < ADAM["beta2"] < 1 or min(ADAM.values()) <= 0:
        raise ConfigError("penalties or steps of the logistic fit are out of order")
    if sorted(p for r in PARTITIONS.values() for p in range(*r)) != list(range(100)):
        raise ConfigError("partitions don't share out the buckets")


check()
