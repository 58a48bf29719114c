import hashlib

import pytest
from pyspark.sql import functions as F

from kinmesh import config
from kinmesh.functions import text, times

CASES = [
    ("email", " A.B+tag@Example.COM ", "a.b+tag@example.com", "valid", []),
    ("email", 'contact: <Alice@example.test> "quoted note"', "alice@example.test", "valid", ["email_extracted_from_export_text"]),
    ("email", "a@example.test and b@example.test", None, "invalid", ["multiple_email_candidates"]),
    ("email", "nothing", None, "invalid", ["invalid_email_structure"]),
    ("email", ".a@example.test", None, "invalid", ["invalid_email_local_part"]),
    ("phone", " +999 (123) 456-789 ", "+999123456789", "valid", []),
    ("phone", "0123 456 789", "0123456789", "valid", ["country_code_not_explicit"]),
    ("phone", "12+34567", None, "invalid", ["invalid_phone_characters"]),
    ("phone", "123", None, "invalid", ["invalid_phone_length"]),
    ("first_name", '  Élodie   Smith "note"\nignored', "élodie smith", "valid", ["trailing_multiline_annotation_removed", "trailing_quoted_annotation_removed"]),
    ("full_name", 'Ada Lovelace "quoted, comma" 😊 hello नमस्ते यार', "ada lovelace", "valid", ["trailing_multilingual_greeting_removed", "trailing_quoted_annotation_removed", "trailing_symbol_annotation_removed"]),
    ("full_name", "Hello Newman", "hello newman", "valid", []),
    ("full_name", "Straße 7", "strasse 7", "valid", ["contains_digit"]),
    ("date_of_birth", "31-12-2000", "2000-12-31", "valid", []),
    ("date_of_birth", "1-3-2026", "2026-03-01", "valid", []),
    ("date_of_birth", "1900-01-01", "1900-01-01", "valid", ["age_above_plausible_limit"]),
    ("date_of_birth", "2030/01/01", "2030-01-01", "valid", ["future_date_of_birth"]),
    ("date_of_birth", "31/31/2000", None, "invalid", ["unrecognized_date_format"]),
    ("country", "U.S.", "US", "valid", []),
    ("country", "Mars", None, "invalid", ["unknown_country_alias"]),
    ("city", "Metro-City", "metro city", "valid", []),
    ("postcode", "SW1A 1AA", "SW1A1AA", "valid", []),
    ("postcode", "A/1", None, "invalid", ["invalid_postcode_characters"]),
    ("device_id", " Device-AbC ", "Device-AbC", "valid", []),
    ("hashed_email", "A" * 64, "a" * 64, "valid", []),
    ("hashed_email", "abc", None, "invalid", ["invalid_sha256_hash"]),
] + [("email", x, None, "missing", []) for x in (None, "", "  ", '""', "NULL", "None")]


def test_golden(spark):
    text.register(spark)
    for concept in sorted({c[0] for c in CASES}):
        rows = [c for c in CASES if c[0] == concept]
        df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i int, x string")
        got = {r.i: r.n for r in df.select("i", F.expr(text.normalized("x", concept)).alias("n")).collect()}
        for i, (_, raw, value, status, flags) in enumerate(rows):
            assert (got[i].value, got[i].status, got[i].flags) == (value, status, flags), (concept, raw)


def test_plain_rules_agree(spark):
    """Values that is_plain holds of get the same from the built-in functions alone, and no plan of theirs has Python in it."""
    text.register(spark)
    for concept in sorted({c[0] for c in CASES}):
        df = spark.createDataFrame([(r[1],) for r in CASES if r[0] == concept] + [("a  B\t$",), ("+1 234 567 890",), ("x\x1f",), (" ",), ("7 up",)], "x string").where(text.is_plain("x", concept))
        both = df.select(F.expr(text.normalized("x", concept, True)).alias("a"), F.expr(text.normalized("x", concept)).alias("b"), F.expr(text.profiling("x", concept, True)).alias("k"), F.expr(text.profiling("x", concept)).alias("l"))
        assert all(r.a == r.b and r.k == r.l for r in both.collect())
        assert "Python" not in df.select(F.expr(text.normalized("x", concept, True)))._jdf.queryExecution().executedPlan().toString()


def test_keys(spark):
    df = spark.createDataFrame([("a.b+tag@example.test", "+999123456789", "000123", "0")], "e string, p string, a string, z string")
    r = df.select(text.email_skeleton(F.col("e")), text.phone_suffix(F.col("p")), text.numeric_account(F.col("a")), text.numeric_account(F.col("z")), text.email_skeleton(F.lit("a@b@c")), text.phone_suffix(F.lit("12345678")), text.numeric_account(F.lit("x1"))).first()
    assert tuple(r) == ("ab@example.test", "123456789", "123", "0", None, None, None)
    names = spark.range(1).select(text.person_names(F.array(F.lit("ada lovelace")), F.array(F.lit("ada")), F.array(F.lit("king"), F.lit("lovelace"))).alias("n")).first().n
    assert sorted(names) == ["adaking", "adalovelace"]


@pytest.mark.parametrize("concept,value,want", [("email", "ada@example.test", "a***@e***.test"), ("date_of_birth", "2000-12-31", "2000-**-**"), ("country", "IN", "I**"), ("phone", "0123456789", "********89"), ("hashed_email", "a" * 64, "aaaaaa…aaaa"), ("city", "ab", "**"), ("city", "metro", "m***"), ("city", "metro city", "met…ty")])
def test_masks(spark, concept, value, want):
    assert spark.range(1).select(text.mask(F.lit(concept), F.lit(value))).first()[0] == want


def test_value_hash(spark):
    assert spark.range(1).select(text.value_hash(F.lit("email"), F.lit("a@b.c"))).first()[0] == hashlib.sha256(b"email\0a@b.c").hexdigest()


def test_times(spark):
    same = ["03-04-2026 12:00:00", "2026/04/03 12:00:00", "04-03-26 12:00", "2026-04-03T12:00:00Z", "1775217600000", "2026-04-03 17:30:00", "2026-04-03T14:00:00+02:00"]
    df = spark.createDataFrame([(x,) for x in [*same, "null", "soon", "31-31-2026 00:00:00"]], "x string")
    got = [str(r[0]) for r in df.select(times.parse(F.col("x"))).collect()]
    assert got == ["2026-04-03 12:00:00"] * len(same) + ["None"] * 3


def test_config():
    config.check()
