"""Normalization, discovery keys and masks as column functions.

Normalization is written as SQL text (one parse a field, where a tree of column calls costs a round trip to the JVM a node).  What needs
Unicode composition, case folding or the removal of stacked export artifacts goes through Arrow functions.  Spark runs those for every
row of the plan they stand in, whatever CASE WHEN is around them; so each rule takes ``plain``: with it there are built-in functions
alone, right for values of which ``is_plain`` is true.  The caller parts the rows by ``is_plain`` first."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinmesh import config

# Patterns of the normalization rules.
EMAIL = r"(?<![A-Za-z0-9.!#$%&'*+/=?^_`{|}~-])[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"
PHONE_ALLOWED = r"(?U)^[+\d\s().-]+$"
ASCII = r"^[\x00-\x7F]*$"
PRINTABLE = r"^[\x20-\x7E]*$"
SPACE, ASCII_RUN = r"(?U)\s+", r"[\x20\t-\r\x1c-\x1f]+"
NOT_DIGIT, UNICODE_NOT_DIGIT = r"\D", r"(?U)\D"
PHONE_PUNCTUATION = r"(?U)[\s().-]+"
POSTCODE, POSTCODE_GAP = r"(?U)^[\w\s-]+$", r"(?U)[\s-]+"
GREETING = re.compile(r"\s+hello\s+[^\x00-\x7f].*$", re.I)
QUOTED = re.compile(r'\s+"[^"\r\n]*"\s*$')

#: What the white space of ASCII text is made of.
ASCII_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
UNICODE_ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, UNICODE_ENDS, "")


def is_missing(x: Column) -> Column:
    return x.isNull() | F.lower(trim(x)).isin(*config.MISSING_TOKENS)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.StringType())
def _casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else v.casefold())


def clean_export_text(text: str) -> tuple[str, list[str]]:
    """The first line without trailing greeting, symbols and quoted notes, in whatever order they are stacked."""
    lines = text.splitlines()
    now, flags = lines[0].strip() if lines else "", []
    if any(x.strip() for x in lines[1:]):
        flags.append("trailing_multiline_annotation_removed")
    steps = (
        ("trailing_multilingual_greeting_removed", lambda s: GREETING.sub("", s).strip()),
        ("trailing_symbol_annotation_removed", _drop_symbols),
        ("trailing_quoted_annotation_removed", lambda s: QUOTED.sub("", s).strip()),
    )
    while now:
        for flag, step in steps:
            if (new := step(now)) != now:
                now = new
                flags.append(flag)
                break
        else:
            break
    return now, flags


def _drop_symbols(s: str) -> str:
    while s and unicodedata.category(s[-1])[0] == "S":
        s = s[:-1].rstrip()
    return s


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("flags", T.ArrayType(T.StringType()))]))
def _export(x: pd.Series) -> pd.DataFrame:
    got = [clean_export_text(v) if v is not None else (None, []) for v in x]
    return pd.DataFrame({"text": [g[0] for g in got], "flags": [g[1] for g in got]})


def register(spark: SparkSession) -> None:
    """The Arrow functions, by the names that the rules call them."""
    for name, f in (("kinmesh_nfkc", _nfkc), ("kinmesh_casefold", _casefold), ("kinmesh_export", _export)):
        spark.udf.register(name, f)


def casefold(x: Column) -> Column:
    return _casefold(x)


def unicode_text(x: Column) -> Column:
    """Compatibility composition and trim."""
    return trim(_nfkc(x))


# ---------------------------------------------------------------- rules as SQL text; x is an expression


def literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def trimmed(x: str, plain: bool) -> str:
    return f"btrim({x}, {literal(ASCII_SPACE)})" if plain else f"regexp_replace({x}, {literal(UNICODE_ENDS)}, '')"


def missing(x: str, plain: bool) -> str:
    return f"({x} IS NULL OR lower({trimmed(x, plain)}) IN ({', '.join(map(literal, config.MISSING_TOKENS))}))"


def is_plain(x: str, concept: str) -> str:
    """Whether the built-in functions alone normalize x right: ASCII, and in names and places nothing that export cleaning would change.  True of null."""
    if config.STRATEGY[concept] not in ("name", "address", "city"):
        return f"coalesce({x} RLIKE {literal(ASCII)}, true)"
    odd_end = r"""[$+<=>^`|~]\s*$|"\s*$"""
    return f"coalesce({x} RLIKE {literal(PRINTABLE)} AND NOT {x} RLIKE {literal(odd_end)}, true)"


def composed(x: str, plain: bool) -> str:
    return trimmed(x if plain else f"kinmesh_nfkc({x})", plain)


def folded(x: str, plain: bool) -> str:
    return f"lower({x})" if plain else f"kinmesh_casefold({x})"


def _result(value: str | None, status: str, flags: str, how: str) -> str:
    return f"named_struct('value', cast({value or 'NULL'} AS string), 'status', {status}, 'flags', cast({flags} AS array<string>), 'transformation', '{how}')"


def _flag(name: str, test: str = "") -> str:
    return f"array_compact(array(if({test}, '{name}', NULL)))" if test else f"array('{name}')"


def _invalid(flag: str, how: str) -> str:
    return _result(None, "'invalid'", _flag(flag), how)


def _settled(x: str, result: str, plain: bool) -> str:
    """result, but missing where x is a missing token."""
    return f"CASE WHEN {missing(x, plain)} THEN {_result(None, literal('missing'), 'array()', 'missing-token exclusion')} ELSE {result} END"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to a value that is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _present(value: str, flags: str, how: str) -> str:
    """A valid value, or missing if it is empty."""
    return _result(f"nullif({value}, '')", f"if({value} = '', 'missing', 'valid')", flags, how)


def normalize_text(x: str, kind: str, plain: bool) -> str:
    t = composed(x, plain)
    cleaned = f"named_struct('text', {t}, 'flags', cast(array() AS array<string>))" if plain else f"kinmesh_export({t})"
    run = literal(ASCII_RUN if plain else SPACE)
    v = folded(f"regexp_replace(({cleaned}).text, {run}, ' ')", plain)
    how = "NFKC + primary export text + case-fold + whitespace collapse"
    if kind == "city":
        v, how = f"trim(regexp_replace(regexp_replace({v}, '[-_.]+', ' '), {run}, ' '))", "NFKC + case-fold + safe city punctuation + whitespace collapse"
    own = f"concat(n.f, array_compact(array(if(n.v RLIKE '\\\\p{{S}}', 'contains_symbol', NULL){", if(n.v RLIKE '(?U)\\\\d', 'contains_digit', NULL)" if kind == "name" else ""})))"
    return _settled(x, _let("n", f"named_struct('v', {v}, 'f', ({cleaned}).flags)", _present("n.v", f"array_sort(array_distinct({own}))", how)), plain)


def normalize_email(x: str, plain: bool) -> str:
    how = "single-address extraction + case-fold"
    local = "substring_index(n.h[0], '@', 1)"
    good = _result("lower(n.h[0])", "'valid'", _flag("email_extracted_from_export_text", "n.h[0] <> n.t"), "NFKC + single-address extraction + case-fold; dots/plus preserved")
    judged = f"""CASE WHEN size(n.h) > 1 THEN {_invalid("multiple_email_candidates", how)} WHEN size(n.h) = 0 THEN {_invalid("invalid_email_structure", how)}
        WHEN {local} LIKE '.%' OR {local} LIKE '%.' OR {local} LIKE '%..%' THEN {_invalid("invalid_email_local_part", how)} ELSE {good} END"""
    t = composed(x, plain)
    return _settled(x, _let("n", f"named_struct('t', {t}, 'h', regexp_extract_all({t}, {literal(EMAIL)}, 0))", judged), plain)


def normalize_hash(x: str, plain: bool) -> str:
    t, how = f"lower({composed(x, plain)})", "trim + case-fold + SHA-256 shape validation"
    return _settled(x, f"CASE WHEN {t} RLIKE '^[0-9a-f]{{64}}$' THEN {_result(t, literal('valid'), 'array()', how)} ELSE {_invalid('invalid_sha256_hash', how)} END", plain)


def normalize_phone(x: str, plain: bool) -> str:
    t, how = composed(x, plain), "safe punctuation removal; no country inference"
    digits = f"regexp_replace({t}, {literal(NOT_DIGIT if plain else UNICODE_NOT_DIGIT)}, '')"
    least, most = config.PHONE_DIGITS
    good = _result("if(n.t LIKE '+%', concat('+', n.d), n.d)", "'valid'", _flag("country_code_not_explicit", "NOT n.t LIKE '+%'"), "NFKC + safe punctuation removal; country code not inferred")
    judged = f"""CASE WHEN NOT n.t RLIKE {literal(PHONE_ALLOWED)} OR contains(substring(n.t, 2), '+') THEN {_invalid("invalid_phone_characters", how)}
        WHEN length(n.d) NOT BETWEEN {least} AND {most} THEN {_invalid("invalid_phone_length", how)} ELSE {good} END"""
    return _settled(x, _let("n", f"named_struct('t', {t}, 'd', {digits})", judged), plain)


def normalize_date(x: str, plain: bool) -> str:
    t, how = composed(x, plain), "declared date format to ISO date"
    shapes = ((r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"))
    day = "coalesce(" + ", ".join(f"if({t} RLIKE {literal(p)}, try_to_timestamp({t}, '{f}'), NULL)" for p, f in shapes) + ")"
    today = f"DATE '{config.REFERENCE_DATE}'"
    age = f"(year({today}) - year(d) - cast(date_format({today}, 'MMdd') < date_format(d, 'MMdd') AS int))"
    flags = f"array_compact(array(if({age} < 0, 'future_date_of_birth', NULL), if({age} > {config.MAX_AGE}, 'age_above_plausible_limit', NULL)))"
    good = _result("date_format(d, 'yyyy-MM-dd')", "'valid'", flags, how)
    return _settled(x, _let("d", f"cast({day} AS date)", f"CASE WHEN d IS NULL THEN {_invalid('unrecognized_date_format', how)} ELSE {good} END"), plain)


def normalize_identifier(x: str, plain: bool) -> str:
    return _settled(x, _let("t", composed(x, plain), _present("t", "array()", "NFKC + trim; case preserved")), plain)


def normalize_postcode(x: str, plain: bool) -> str:
    how = "NFKC + uppercase + safe space/hyphen removal"
    body = f"CASE WHEN NOT t RLIKE {literal(POSTCODE)} THEN {_invalid('invalid_postcode_characters', how)} ELSE {_present(f'upper(regexp_replace(t, {literal(POSTCODE_GAP)}, {literal(str())}))', 'array()', how)} END"
    return _settled(x, _let("t", composed(x, plain), body), plain)


def normalize_country(x: str, plain: bool) -> str:
    how = "NFKC + ISO country alias mapping"
    known = "map(" + ", ".join(literal(v) for kv in config.COUNTRY_ALIASES.items() for v in kv) + f")[regexp_replace(upper({composed(x, plain)}), '[^A-Z0-9]+', '')]"
    return _settled(x, _let("k", known, f"CASE WHEN k IS NULL THEN {_invalid('unknown_country_alias', how)} ELSE {_result('k', literal('valid'), 'array()', how)} END"), plain)


def normalized(x: str, concept: str, plain: bool = False) -> str:
    """SQL text of value, status (valid, missing, invalid), flags and transformation of a concept's raw text x; plain: of values that is_plain
    holds of; else register() must have been called in the session."""
    kind = config.STRATEGY[concept]
    own = {"email": normalize_email, "sha256_hash": normalize_hash, "phone": normalize_phone, "date_of_birth": normalize_date, "identifier": normalize_identifier, "postcode": normalize_postcode, "country": normalize_country}
    return own[kind](x, plain) if kind in own else normalize_text(x, kind, plain)


def profiling(x: str, concept: str, plain: bool = False) -> str:
    """SQL text of profiling_key."""
    t = trimmed(x, plain)
    key = folded(t, plain) if concept in ("email", "hashed_email") else f"if({t} RLIKE {literal(PHONE_ALLOWED)}, regexp_replace({t}, {literal(PHONE_PUNCTUATION)}, ''), {t})" if concept == "phone" else t
    return f"CASE WHEN NOT {missing(x, plain)} THEN {key} END"


# ---------------------------------------------------------------- profiling keys, hashes, masks


def profiling_transformation(x: Column, concept: Column) -> Column:
    return F.when(is_missing(x), "missing-token exclusion").when(concept.isin("email", "hashed_email"), "trim + case-fold").when((concept == "phone") & trim(x).rlike(PHONE_ALLOWED), "trim + safe punctuation removal").otherwise("trim only")


def value_hash(concept: Column, key: Column) -> Column:
    return F.sha2(F.concat(concept, F.lit("\0"), key), 256)


def mask(concept: Column, x: Column) -> Column:
    """A display form that doesn't show the value."""
    n = F.length(x)
    domain = F.regexp_extract(x, r"(?s)^[^@]*@(.*)$", 1)
    first = lambda s: F.when(s == "", "*").otherwise(F.substring(s, 1, 1))
    email = F.concat(first(F.regexp_extract(x, r"(?s)^([^@]*)@", 1)), F.lit("***@"), first(F.regexp_extract(domain, r"(?s)^([^.]*)", 1)), F.lit("***"), F.regexp_extract(domain, r"(?s)(\..*)$", 1))
    right = lambda k: F.substring(x, n - k + 1, F.lit(k))
    return (
        F.when((concept == "email") & x.contains("@"), email)
        .when((concept == "date_of_birth") & (n >= 4), F.concat(F.when(x.rlike(r"^\d{4}"), F.substring(x, 1, 4)).otherwise("****"), F.lit("-**-**")))
        .when((concept == "country") & (n <= 3), F.concat(F.substring(x, 1, 1), F.lit("**")))
        .when(concept == "phone", F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(4), n - 2)), F.when(n < 2, x).otherwise(right(2))))
        .when(concept == "hashed_email", F.when(n > 12, F.concat(F.substring(x, 1, 6), F.lit("…"), right(4))).otherwise("***"))
        .when(n <= 2, F.repeat(F.lit("*"), n))
        .when(n <= 6, F.concat(F.substring(x, 1, 1), F.lit("***")))
        .otherwise(F.concat(F.substring(x, 1, 3), F.lit("…"), right(2)))
    )


def potential_pairs(n: Column) -> Column:
    return F.when(n < 2, 0).otherwise(F.floor(n * (n - 1) / 2)).cast("long")


# ---------------------------------------------------------------- discovery keys


def email_skeleton(x: Column) -> Column:
    """Without dots and plus suffix in the local part; null unless there is one @ with text on both sides."""
    local = F.regexp_replace(F.regexp_replace(F.regexp_extract(x, "(?s)^([^@]*)@", 1), r"(?s)\+.*$", ""), r"\.", "")
    domain = F.regexp_extract(x, "(?s)@([^@]*)$", 1)
    return F.when(x.rlike("(?s)^[^@]*@[^@]*$") & (local != "") & (domain != ""), F.concat(local, F.lit("@"), domain))


def compact(x: Column) -> Column:
    return F.regexp_replace(casefold(unicode_text(x)), r"[^\p{L}\p{N}]", "")


def person_names(full: Column, first: Column, last: Column) -> Column:
    """Compact full names and all first-last pairs; arrays in, array out."""
    pairs = F.flatten(F.transform(first, lambda a: F.transform(last, lambda b: F.concat(a, F.lit(" "), b))))
    names = F.transform(F.concat(full, pairs), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))
    return F.array_distinct(F.array_remove(names, ""))


def phone_suffix(x: Column) -> Column:
    digits = F.regexp_replace(x, r"(?U)\D", "")
    return F.when(F.length(digits) >= 9, F.substring(digits, -9, 9))


def numeric_account(x: Column) -> Column:
    return F.when(x.rlike(r"(?U)^\d+$"), F.regexp_replace(x, r"^0+(?=.)", ""))
