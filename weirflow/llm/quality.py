"""Quality rules: fixed counts of each text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed one- and two-word n-grams: one of trusted target documents, one of
the whole raw corpus. A document's score is the mean log ratio of its n-grams; one fixed threshold decides for every
document. Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weirflow.llm.common import staged

#: The white space that separates words, for the regular expression and for trimming.
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Buckets of the hashed n-grams; the table of log ratios has so many numbers, whatever the corpus.
BUCKETS = 16_384
#: Trusted rows that the target multinomial is fitted on: of more, those with the least hash of their id.
MOST_TRUSTED = 20_000
#: Pseudo-count of each bucket.
SMOOTHING = 1.0
#: A document is kept from this mean log ratio on.
THRESHOLD = -0.1


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _paired(left: Column, right: Column, by: int) -> Column:
    """Hashes of left[i] and right[i + by], for each i that has both."""
    count = F.greatest(F.size(right) - by, F.lit(0))
    return F.zip_with(F.slice(left, 1, count), F.slice(right, by + 1, count), lambda a, b: F.xxhash64(a, b))


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), chars, text)


def with_words(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, _text (null: empty), _words, _hashes of the words, and _pairs of neighbouring words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim("_text", F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN))
    return (
        docs.select(*columns, text.alias("_text"))
        .withColumn("_words", words)
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_pairs", _paired(F.col("_hashes"), F.col("_hashes"), 1))
    )


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(value, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """(bucket, ratio): log of the target's over the raw corpus's share of the bucket, from the n-grams of all docs.

    trusted(doc_id) names target documents; at most most_trusted of them count, so it may be broadcast. Without any
    trusted document all ratios are 0. Buckets that no document has are left out.
    """
    chosen = trusted.select(F.col("doc_id").cast("long").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(most_trusted)
    flagged = with_words(docs.withColumn("_doc", docs["doc_id"].cast("long")), "_doc").join(
        F.broadcast(chosen.withColumn("_target", F.lit(1))), F.col("_doc") == F.col("_id"), "left"
    )
    grams = flagged.select(F.coalesce("_target", F.lit(0)).alias("_target"), F.explode(F.concat("_hashes", "_pairs")).alias("_gram"))
    counts = grams.groupBy(_bucket(F.col("_gram"), buckets).alias("bucket")).agg(
        F.count("*").alias("raw"), F.sum("_target").cast("long").alias("target")
    )
    counts = staged(counts, "ngram-counts")  # at most as many rows as buckets
    whole = lambda part: counts.agg(F.sum(part)).scalar()
    share = lambda part: (F.col(part) + SMOOTHING) / (whole(part) + SMOOTHING * buckets)
    ratio = F.when(whole("target") == 0, F.lit(0.0)).otherwise(F.log(share("target")) - F.log(share("raw")))
    return counts.select("bucket", ratio.alias("ratio"))


def ratio_table(ratios: DataFrame, buckets: int = BUCKETS) -> Column:
    """The log ratios as one array of fixed length, a scalar subquery; buckets that are left out have ratio 0."""
    every = ratios.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(ratios, "bucket", "left").select("bucket", F.coalesce("ratio", F.lit(0.0)).alias("ratio"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "ratio"))), lambda e: e["ratio"])).scalar()


def counts(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what with_words adds."""
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    fours = _paired(F.col("_pairs"), F.col("_pairs"), 2)
    found = (
        with_words(docs, *columns)
        .withColumn("_lines", lines)
        .withColumn("_windows", _paired(fours, F.col("_hashes"), WINDOW - 1))
        .withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    )
    # Only a text with a repeated window goes on: its windows in order of their hash, those equal to a neighbour, and how many words their places cover.
    ordered = F.when(F.col("_again"), F.sort_array(F.transform("_windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    equal = F.when(F.col("_again"), F.zip_with(F.slice("_ordered", 1, F.size("_ordered") - 1), _shifted(F.col("_ordered"), 1), lambda a, b: a["w"] == b["w"]))
    # get() is null beyond either end
    twice = lambda k: F.coalesce(F.get("_equal", k - 1), F.lit(False)) | F.coalesce(F.get("_equal", k), F.lit(False))
    places = F.when(F.col("_again"), F.array_sort(F.filter(F.transform("_ordered", lambda e, k: F.when(twice(k), e["i"])), lambda i: i.isNotNull())))
    steps = F.zip_with("_places", _shifted(F.col("_places"), 1), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    return (
        found.withColumn("_ordered", ordered)
        .withColumn("_equal", equal)
        .withColumn("_places", places)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.length(_without(text, SPACE)).cast("long"),
                "n_symbols": (F.length("_text") - F.length(_without(text, SYMBOLS))).cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long"),
            }
        )
    )


def _verdicts(docs: DataFrame, ratios: Column, columns: list[str], buckets: int, threshold: float) -> DataFrame:
    total = F.aggregate(F.concat("_hashes", "_pairs"), F.lit(0.0), lambda t, g: t + F.get("_ratios", _bucket(g, buckets)))
    grams = F.size("_hashes") + F.size("_pairs")
    return (
        counts(docs, *columns)
        .withColumn("_ratios", ratios)
        .withColumn("score", F.when(grams > 0, total / grams).otherwise(F.lit(0.0)))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )


def score(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, the counts, base_failed, kept and score.

    labels(doc_id, quality) gives the trusted target: rows of quality 1. A null text is the empty text: no words, so
    base_failed. The score of a text without words is 0. Repeated rows give repeated rows; an empty table none.
    """
    ratios = ratio_table(log_ratios(docs, labels.where("quality = 1"), buckets), buckets)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    return _verdicts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ratios, ["doc_id"], buckets, threshold).select("doc_id", *names)


def keep(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that are kept.

    A null text is the empty text, which fails the base rules and goes. Repeated rows are judged alike, so all stay or
    all go; a score equal to the threshold stays. An empty table gives no rows. No column name can clash: the row is
    carried as one value. Labels with a null id or quality name no target.
    """
    ratios = ratio_table(log_ratios(docs, labels.where("quality = 1"), buckets), buckets)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col("text").cast("string").alias("text"))
    judged = _verdicts(packed, ratios, ["_row"], buckets, threshold).select("_row", "kept", F.monotonically_increasing_id().alias("_place"))
    # The place keeps the optimizer from moving the filter below the counts, where it would repeat all their expressions inside each other.
    return judged.where(F.col("kept") & (F.col("_place") >= 0)).select("_row.*")
