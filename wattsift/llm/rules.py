"""Quality rules: plain measures of a text, and a hashed n-gram log-likelihood ratio between trusted and raw text.

DataFrame functions only. Words hash to 64 bits; word and word-pair hashes fall into ``buckets`` counters. The
ratio of a bucket is the log of its share in trusted documents over its share in all documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattsift.llm.frames import BLANK, NON_BLANK, without
from wattsift.session import written

WINDOW = 5
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.coalesce(F.filter(F.split(text, BLANK), lambda w: w != ""), F.array().cast("array<string>"))


def _window_hashes(h: Column) -> Column:
    at = lambda i, k: F.get(h, i + k)
    last = F.size(h) - WINDOW
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows found twice or more. Only texts with such windows sort them."""
    pairs = F.array_sort(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))

    same = lambda x, y: x["v"].eqNullSafe(y["v"])

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
        step = lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(i, a["end"])).cast("bigint").alias("n"), (i + WINDOW).alias("end")
        )
        return F.aggregate(F.array_sort(F.transform(twice, lambda x: x["i"])), start, step, lambda a: a["n"])

    some = F.size(F.array_distinct(windows)) < F.size(windows)
    return F.when(some, let(pairs, count)).otherwise(F.lit(0).cast("bigint"))


def ngram_buckets(h: Column, buckets: int) -> Column:
    """Counter of every word and every pair of neighbouring words, given the words' hashes."""
    low = F.lit(buckets - 1).cast("bigint")
    pairs = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))
    return F.transform(F.concat(h, F.slice(pairs, 1, F.greatest(F.size(h) - 1, F.lit(0)))), lambda x: x.bitwiseAND(low).cast("int"))


def hashed_words(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def bucket_ratios(
    docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, buckets: int, even: float
) -> Column:
    """An array with the log ratio of every bucket, ``buckets`` numbers however many documents there are.

    Raw counts are over all documents. Trusted ones are all those labelled 1. Both shares get ``even`` parts of an even spread on top, so that rare buckets say little.
    """
    known = labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("trusted_id")).agg(F.avg(label).alias("mean"))
    trusted = known.where(F.col("mean") >= 0.5).select("trusted_id")
    # labels grow with the corpus, so they are never broadcast: the plan is the same at every size
    marked = docs.select(F.col(id).alias("own_id"), F.col(text).alias("own_text")).join(
        trusted.hint("merge"), F.col("own_id") == F.col("trusted_id"), "left"
    )
    grams = marked.select(
        F.col("trusted_id").isNotNull().cast("bigint").alias("good"), F.explode(let(hashed_words(F.col("own_text")), lambda h: ngram_buckets(h, buckets))).alias("bucket")
    )
    counts = written(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")), "grams")
    raw, good = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").na.fill(0)
    share = lambda c, total: F.log(F.col(c) / F.lit(float(max(total, 1))) + F.lit(even / buckets))
    ratio = share("good", good) - share("raw", raw)
    held = every.select("bucket", F.round(ratio if good else F.lit(0.0), 9).alias("ratio")).orderBy("bucket").toArrow()
    # one constant array; the optimizer works the cast out once
    return F.split(F.lit(",".join(map(repr, held.column("ratio").to_pylist()))), ",").cast("array<double>")


def judge(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = 1 << 16,
    even: float = 0.3, threshold: float = -0.12,
) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_ratio and kept to every document.

    log_ratio is the mean log ratio of the text's words and word pairs, and a document that passes the plain rules is kept
    if it reaches ``threshold``. Without trusted documents all ratios are 0.

    Words are runs between blanks. A NULL or empty text has none, fails the plain rules (fewer than 10 words) and has
    log_ratio 0. Repeated rows count and are answered each. Columns of these names are replaced.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio", "kept"]
    base = without(docs, *added, "rule_hashes", "rule_windows")
    ratios = bucket_ratios(docs, labels, id, text, label, buckets, even)
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NON_BLANK))
    zero = F.lit(0.0)
    mean = let(
        ngram_buckets(F.col("rule_hashes"), buckets),
        lambda g: F.when(F.size(g) > 0, F.aggregate(g, zero, lambda a, b: a + F.get(ratios, b)) / F.size(g)).otherwise(zero),
    )
    measured = (
        base.withColumn("rule_hashes", hashed_words(body))
        .withColumn("rule_windows", _window_hashes(F.col("rule_hashes")))
        .withColumns(
            {
                "n_words": F.size("rule_hashes").cast("bigint"),
                "word_chars": F.length(F.regexp_replace(body, BLANK, "")).cast("bigint"),
                "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("bigint"),
                "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
                "n_repeat_words": _covered(F.col("rule_windows")),
                "log_ratio": F.round(mean, 6),
            }
        )
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))
    return out.select(*base.columns, *added)
