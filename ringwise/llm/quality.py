"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio between two multinomials.

Unigrams and bigrams of a text's words are hashed into a fixed number of buckets.  Two multinomials over the buckets are
counted: one over all documents (raw corpus), one over trusted documents.  A document's score is the sum over its
n-grams of ``log(p_trusted / p_raw)``, divided by their number.  Every document is kept or rejected by comparing its
score with one threshold; nothing is drawn at random.

The threshold is the score that all but a small share of the trusted documents reach, lowered by a margin, so that
documents that look like trusted ones stay whatever their language or topic.

Everything is DataFrame expressions: words and n-gram buckets are arrays inside the row, counts are one group-by over
at most ``BUCKETS`` keys with map-side partial sums, and the log ratios come back as one array of that fixed size.
All trusted documents are counted, and the threshold is an exact quantile over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringwise.plans.quantile import exact_quantiles
from ringwise.session import few, files, stored

#: Buckets of the two multinomials.
BUCKETS = 1 << 14
#: Bits for each id of a bitmap that marks ids: about one other id in sixteen meets a set bit too.
BITS = 16
#: Bitmaps of 4 KB that fill a file.
MAPS = 1000
#: Share of the trusted documents that may score below the threshold before the margin is taken off.
TAIL = 0.01
MARGIN = 0.05
#: Pseudo-count of every bucket.
SMOOTHING = 1.0

_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = r"[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Runs without ASCII white space, in order."""
    return F.array_remove(F.split(text, _SPACE), "")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_q_text`` (null: empty), ``_q_words`` and ``_q_hash`` (64-bit hash of each word)."""
    return (docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
            .withColumn("_q_words", words_of(F.col("_q_text")))
            .withColumn("_q_hash", F.transform("_q_words", lambda w: F.xxhash64(w))))


def _windows(h: Column, n: Column) -> Column:
    """Hash of every window of three words."""
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3),
                                      lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))).otherwise(
        F.array().cast("array<bigint>"))


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words that lie in a three-word window found twice or more in the text.

    Window hashes are sorted; those equal to a neighbour occur twice.  Only texts that have such windows look at
    positions: the window starts are sorted by hash, and each repeated start covers three words or as many as lie
    before the next repeated start.
    """
    n = F.size("_q_words")
    df = df.withColumn("_q_win", _windows(F.col("_q_hash"), n))
    distinct = F.size(F.array_distinct("_q_win"))
    pairs = F.array_sort(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_q_pairs", F.when(distinct < F.size("_q_win"), pairs))
    p = F.col("_q_pairs")
    again = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(p, k + 1)["h"].eqNullSafe(x["h"])))
    df = df.withColumn("_q_at", F.array_sort(F.transform(again, lambda x: x["i"])))
    at = F.col("_q_at")
    covered = F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
                          F.lit(0), lambda t, x: t + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")) \
        .drop("_q_win", "_q_pairs", "_q_at")


def base_rules(df: DataFrame) -> DataFrame:
    """Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` to ``with_words`` output."""
    text = F.col("_q_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = repeat_words(df.withColumn("_q_lines", lines))
    out = (df.withColumn("n_words", F.size("_q_words").cast("long"))
           .withColumn("word_chars", F.length(F.regexp_replace(text, _SPACE, "")).cast("long"))
           .withColumn("n_symbols", (F.length(text) - F.length(F.regexp_replace(text, _SYMBOLS, ""))).cast("long"))
           .withColumn("n_dup_lines", (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long")))
    return out.drop("_q_lines").withColumn(
        "base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def grams(h: Column) -> Column:
    """Buckets of all unigrams and bigrams of a word-hash array."""
    tail = F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))
    lead = F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0)))
    return F.concat(F.transform(h, _bucket), F.zip_with(lead, tail, lambda a, b: _bucket(F.xxhash64(a, b))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all trusted documents of ``labels(doc_id, quality, toxic)``: good quality, not toxic."""
    return (labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
            .select(F.col("doc_id").cast("long").alias("_q_id")).distinct())


def marked(ids: DataFrame, level: int) -> tuple[DataFrame, int]:
    """Bitmaps ``(part, bits)`` with a set bit at the hash of every one of ``ids(_q_id)``, and how many bits there are."""
    size = (ids.count() * BITS // 32_768 + 1) * 32_768
    bit = _bit(level, size)
    maps = (ids.groupBy(F.bitmap_bucket_number(bit).alias("_q_part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_q_map")))
    return stored(few(maps, 1 + size // 32_768 // MAPS)), size


def _bit(level: int, size: int) -> Column:
    return F.pmod(F.xxhash64(F.col("_q_id"), F.lit(level)), F.lit(size))


def meets(rows: DataFrame, level: int, maps: DataFrame, size: int) -> DataFrame:
    """``rows(_q_id, ...)`` with ``_q_met``: whether the id's bit is set (null id: not).  Every task gets the bitmaps."""
    at = F.bitmap_bit_position(_bit(level, size))
    byte = F.conv(F.hex(F.substring(F.col("_q_map"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = F.col("_q_id").isNotNull() & F.col("_q_map").isNotNull() & (F.getbit(F.coalesce(byte, F.lit(0)), (at % 8).cast("int")) == 1)
    return (rows.withColumn("_q_part", F.bitmap_bucket_number(_bit(level, size))).join(F.broadcast(maps), "_q_part", "left")
            .withColumn("_q_met", met).drop("_q_part", "_q_map"))


def trusted_docs(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``trusted(_q_id)``, without moving a text.

    A cascade of bitmaps decides exactly for the ids of ``docs``: the first marks the trusted ids, the second the others
    that meet it, the third the trusted ones that meet the second, and so on until nothing is met by mistake.  A row is
    trusted if the number of bitmaps that it meets one after another is odd.  Only ids are shuffled; the bitmaps take some
    two bytes for each trusted id, and each is about a sixteenth of the one two places before.
    """
    rows = docs.withColumn("_q_id", F.col("doc_id").cast("long"))
    ids = rows.select("_q_id").where("_q_id is not null").distinct()
    seen = stored(few(ids.join(trusted.withColumn("_q_good", F.lit(True)), "_q_id", "left"), files(docs.count())))
    inside = seen.where("_q_good").select("_q_id")
    outside = seen.where("_q_good is null").select("_q_id")
    rows, level = rows.withColumn("_q_met", F.lit(True)).withColumn("_q_n", F.lit(0)), 0
    while not inside.isEmpty():
        maps, size = marked(inside, level)
        rows = meets(rows.withColumnRenamed("_q_met", "_q_on"), level, maps, size)
        rows = rows.withColumn("_q_met", F.col("_q_on") & F.col("_q_met")).drop("_q_on") \
            .withColumn("_q_n", F.col("_q_n") + F.col("_q_met").cast("int"))
        inside, outside = stored(meets(outside, level, maps, size).where("_q_met").select("_q_id")), inside
        level += 1
    return rows.where("_q_n % 2 = 1").select(*docs.columns)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> Column:
    """Array literal-like column: log(p_trusted / p_raw) of every bucket, as a scalar subquery.

    ``docs`` and ``trusted`` (the trusted ones of them) are ``with_words`` rows.
    """
    def counts(rows, name):
        return (rows.select(F.explode(grams(F.col("_q_hash"))).alias("b")).groupBy("b")
                .agg(F.count(F.lit(1)).alias(name)))

    every = (docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"))
             .join(counts(docs, "raw"), "b", "left").join(counts(trusted, "good"), "b", "left").select(
        "b", (F.coalesce("raw", F.lit(0)) + SMOOTHING).alias("raw"), (F.coalesce("good", F.lit(0)) + SMOOTHING).alias("good")))
    every = stored(few(every, files(BUCKETS)))  # asked for by the threshold and by the result
    rows = every.agg(F.array_sort(F.collect_list(F.struct("b", "good", "raw"))).alias("x"),  # BUCKETS rows
                     F.sum("good").alias("all_good"), F.sum("raw").alias("all_raw"))
    shift = F.log(F.col("all_raw") / F.col("all_good"))
    return rows.select(F.transform("x", lambda r: F.log(r["good"] / r["raw"]) + shift).alias("w")).scalar()


def score(ratios: Column, h: str = "_q_hash") -> Column:
    """Mean log ratio of a document's n-grams; 0 without words."""
    g = F.col("_q_grams")
    total = F.aggregate(g, F.lit(0.0), lambda t, b: t + F.get(ratios, b))
    return F.when(F.size(g) > 0, total / F.size(g)).otherwise(F.lit(0.0))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``with_words`` rows of ``docs`` with ``llr``, ``threshold`` and the base counts."""
    rows = with_words(docs)
    texts = docs.select("doc_id", "text")
    good = with_words(trusted_docs(texts, trusted_ids(labels)))
    ratios = log_ratios(with_words(texts), good)

    def with_score(df):
        return df.withColumn("_q_w", ratios).withColumn("_q_grams", grams(F.col("_q_hash"))) \
            .withColumn("llr", score(F.col("_q_w"))).drop("_q_w", "_q_grams")

    fitted = stored(few(with_score(good).select("llr"), files(docs.count())))
    threshold = exact_quantiles(fitted, "llr", [TAIL]).select((F.col("q0") - MARGIN).alias("t")).scalar()
    return base_rules(with_score(rows)).withColumn("threshold", F.coalesce(threshold, F.lit(float("-inf"))))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every column of ``docs(doc_id, text, ...)`` with the base counts, ``llr``, ``threshold`` and ``kept``.

    Null text is empty: no words, so the base rule fails it.  Without trusted documents every document that passes the
    base rules is kept.  Rows are judged one by one, so repeated rows and null ids get their own answers.  Columns of
    ``docs`` with the names of the results are replaced.
    """
    out = scored(docs, labels).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.col("threshold")))
    return out.drop("_q_text", "_q_words", "_q_hash")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    rows = docs.select("doc_id", "text", F.struct("*").alias("_q_row"))
    # the partition number keeps the filter above the projections; pushed below, it would repeat their nested arrays
    judged = judge(rows, labels).select("_q_row", "kept", F.spark_partition_id().alias("_q_at"))
    return judged.where("kept and _q_at >= 0").select("_q_row.*")
