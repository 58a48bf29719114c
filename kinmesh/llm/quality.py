"""Quality rules: plain counts, then a hashed n-gram log-likelihood ratio.  DataFrame operations only.

Counts of a text's words ``[^\\x20\\x09-\\x0D]+``: n_words, word_chars (code points in words), n_symbols (of
``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words inside a
5-word window that occurs twice or more in the text, first included).  base_failed: under 10 words, or over
20 % repeat words.

The method: unigrams and bigrams are hashed into BUCKETS.  Two smoothed multinomials are
fitted: of trusted documents (labels with quality 1 and toxic 0) and of the whole corpus.  A document's score
is the mean over its n-grams of log p_trusted - log p_corpus; every document whose score is below THRESHOLD,
and every one that failed the base rules, is rejected.  The corpus's counts cover every document.  The trusted
side is fitted on TRUSTED_MOST labelled documents at most, taken by hash, so that their ids can be broadcast.

Null text: no words; base_failed.  Without any trusted document the two models are equal, the scores 0 and
the base rules decide.  Null doc_id: never trusted.  Repeated rows: each counts.  Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.llm.shared import let

BUCKETS = 1 << 16
#: Added to each bucket's count, in shares of the corpus's own distribution.
SMOOTHING = 1.0
THRESHOLD = -0.15
TRUSTED_MOST = 200_000
LEAST_WORDS = 10
MOST_REPEATED = 20  # percent
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def hashes(w: Column) -> Column:
    """XXH64 of each word: windows, unigrams and bigrams are hashed from these."""
    return F.transform(w, lambda x: F.xxhash64(x))


def repeat_words(v: Column) -> Column:
    """How many words stand in a WINDOW-word window that occurs twice or more; v: the words' hashes.  Only if
    a window's hash is there twice, they are sorted with their places: neighbours that are equal occur again."""

    def places(s: Column) -> Column:
        again = lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, k: F.coalesce(again(e, k), F.lit(False))), lambda e: e["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)

    def count(v: Column) -> Column:
        windows = F.transform(F.slice(v, 1, F.size(v) - WINDOW + 1), lambda x, i: F.xxhash64(x, *(F.get(v, i + k) for k in range(1, WINDOW))))
        sort = lambda h: let(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places), covered)
        return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(sort(h)))

    return let(v, lambda v: F.when(F.size(v) <= WINDOW, F.lit(0)).otherwise(count(v)))


def lines_again(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def buckets(v: Column) -> Column:
    """The buckets of the unigrams and bigrams of a text; v: its words' hashes."""
    low = F.lit(BUCKETS - 1)
    bigrams = lambda v: F.transform(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get(v, i), x).bitwiseAND(low))
    return let(v, lambda v: F.concat(F.transform(v, lambda x: x.bitwiseAND(low)), bigrams(v)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """TRUSTED_MOST distinct ids at most, by hash, of labels with quality 1 and not toxic."""
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_MOST)


def ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ratio, the array of log p_trusted - log p_corpus of each bucket.  Counts are summed on the map
    side; a bucket costs a row a task."""
    good = F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("__good")))
    marked = docs.select("doc_id", "text").join(good, F.col("doc_id") == F.col("__good"), "left")
    grams = marked.select(F.col("__good").isNotNull().cast("long").alias("good"), F.explode(buckets(hashes(words(F.col("text"))))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").fillna(0, ["n", "g"])
    pack = dense.agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "g"))).alias("m"), F.sum("n").alias("n"), F.sum("g").alias("g"))
    # p_corpus = (n + 1) / (N + B); p_trusted is smoothed towards p_corpus, so that buckets unseen there count little
    weight = SMOOTHING * BUCKETS

    def ratio(b: Column) -> Column:
        corpus = (b["n"] + 1) / (F.col("n") + BUCKETS)
        return F.when(F.col("g") == 0, F.lit(0.0)).otherwise(F.log((b["g"] + weight * corpus) / (F.col("g") + weight)) - F.log(corpus))

    return pack.select(F.transform("m", ratio).alias("ratio"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' columns in a struct ``doc``, the counts, score and kept."""
    model = ratios(docs, labels).scalar()
    text = F.col("text")
    split = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("doc"), F.coalesce(text, F.lit("")).alias("text")).select("doc", "text", words(text).alias("w"))
    counted = split.select("doc", "text", "w", hashes(F.col("w")).alias("v"), model.alias("ratio"))
    rows = counted.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines_again(F.col("text")).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("v")).cast("long").alias("n_repeat_words"),
        # ratio is named once, so that the optimizer puts the subquery's value here and no row carries it
        let(buckets(F.col("v")), lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(F.col("ratio"), x.cast("int"))) / F.greatest(F.size(b), F.lit(1))).alias("score"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= THRESHOLD))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_documents(docs, labels).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, as they are."""
    return score_documents(docs, labels).where("kept").select("doc.*")
