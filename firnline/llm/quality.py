"""Quality rules: base counts, and a likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.llm.rows import flagged
from firnline.llm.text import col, crc32, words
from firnline.operators.ranks import with_positions
from firnline.session import cut_lineage

# The characters that count as symbols, and those of words.
SYMBOLS = "[#*$%&|<>]"
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Cells that n-grams are hashed to. Bounds the model: one long for each.
BUCKETS = 1 << 14
#: Trusted documents that the check SQL goes up to. Nothing here is bounded by it: beyond it the two differ.
MAX_TRUSTED = 20_000
#: The threshold lies as far under the LOW_SHARE quantile of the trusted documents' scores as that lies under their median.
LOW_SHARE = 0.002


def codes(word_array: Column) -> Column:
    """CRC-32 of every word."""
    return F.transform(word_array, crc32)


def repeating_windows(word_array: Column, code_array: Column, n: Column) -> Column:
    """The three-word windows with their places, sorted, if any of them can occur twice; else empty.

    If the hashes of the windows' codes all differ, none repeats, which settles
    most texts. Both arrays have to be plain columns.
    """
    at = lambda i, k: F.get(word_array, i + k)
    hashes = F.slice(F.transform(code_array, lambda c, i: F.xxhash64(c, F.get(code_array, i + 1), F.get(code_array, i + 2))),
                     1, F.greatest(n - 2, F.lit(0)))
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("w"), i.alias("i")))
    none = F.array().cast("array<struct<w:string,i:int>>")
    return F.when((n < 3) | (F.size(F.array_distinct(hashes)) == n - 2), none).otherwise(F.sort_array(windows))


def covered_words(sorted_windows: Column) -> Column:
    """How many words lie in windows that equal a neighbour in the sorted array, which is a plain column."""
    same = lambda x, k: F.coalesce(F.get(sorted_windows, k)["w"] == x["w"], F.lit(False))
    twice = F.filter(sorted_windows, lambda x, k: same(x, k - 1) | same(x, k + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, codes, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row.

    A null or empty text has no words and zero counts. Each row is judged by
    itself, so repeated rows and null ids give a result each.
    """
    body = F.coalesce(col(docs, text_col), F.lit(""))
    first = docs.select(col(docs, id_col).alias("doc_id"), words(body).alias("words"),
                        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                        F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD_CHAR)).alias("lines"))
    n = F.size("words")
    first = first.withColumn("codes", codes(F.col("words")))
    return first.withColumn("windows", repeating_windows(F.col("words"), F.col("codes"), n)).select(
        "doc_id", "codes", n.cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda a, w: a + F.length(w)).alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered_words(F.col("windows")).cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cells(code_array: Column, buckets: int) -> Column:
    """Hash cells of all words and of all pairs of neighbouring words, from the codes in a plain column."""
    ones = F.transform(code_array, lambda a: F.pmod(a, F.lit(buckets)).cast("int"))
    twos = F.transform(code_array, lambda a, i: F.pmod(a * 31 + F.get(code_array, i + 1) + 7, F.lit(buckets)).cast("int"))
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(code_array) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic, each once, in the type that ``docs`` has (hashes depend on it)."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
    kind = docs.select(col(docs, "doc_id")).schema[0].dataType
    return good.select(F.col("doc_id").try_cast(kind).alias("doc_id")).where("doc_id is not null").distinct()


def fit_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, llr): log of trusted over raw probability of each cell, in whole millionths.

    The raw multinomial counts the n-grams of all documents, the target those
    of all trusted ones; every cell gets one pseudo-count in both. Counts are
    summed within tasks first, so a shuffle carries one row per task and cell.
    ``trusted`` may be of any size; it has distinct ids.
    """
    texts = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"))
    marked = flagged(texts, "doc_id", trusted, "good").select("good", codes(words(F.col("text"))).alias("codes"))
    seen = (marked.select(F.col("good").cast("bigint").alias("good"), F.explode(cells(F.col("codes"), buckets)).alias("bucket"))
            .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("good").alias("good")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(seen, "bucket", "left").select(
        "bucket", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("raw", "good")])
    full = cut_lineage(full)
    total = full.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    share = lambda c: F.log((F.col(f"f.{c}") + 1) / (F.col(f"t.{c}") + F.lit(buckets)))
    return cut_lineage(full.alias("f").join(F.broadcast(total.alias("t"))).select(
        "bucket", F.round((share("good") - share("raw")) * 1e6).cast("int").alias("llr")))


def scored(docs: DataFrame, model: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The base counts with score: the mean log ratio over a document's n-grams, null without words.

    The model, ``buckets`` numbers by construction, is one broadcast row that
    each document looks its cells up in; documents are not shuffled.
    """
    ratios = (model.agg(F.array_sort(F.collect_list(F.struct("bucket", "llr"))).alias("m"))
              .select(F.lit(1).alias("_one"), F.col("m.llr").alias("ratios")))
    base = base_counts(docs).withColumn("cells", cells(F.col("codes"), buckets)).withColumn("_one", F.lit(1))
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, b: a + F.get("ratios", b))
    return base.join(F.broadcast(ratios), "_one").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.size("cells") > 0, total / (F.size("cells") * 1e6)).alias("score"))


def least_score(scores: DataFrame, low_share: float = LOW_SHARE) -> float | None:
    """2 q - m of the column score, with its ``low_share`` quantile q and its median m; None without rows.

    Scores are ranked over all tasks; only those at the ranks next to both
    quantiles, four at most, come to the driver. Ids split a score that many share.
    """
    placed = with_positions(scores.select("score", "doc_id"), ["score", "doc_id"])
    places = [p * (F.col("n_rows") - 1) for p in (low_share, 0.5)]
    near = placed.where(F.col("position").isin(*[end(at) for at in places for end in (F.floor, F.ceil)])).collect()
    if not near:
        return None
    found, last = {r.position: r.score for r in near}, near[0].n_rows - 1

    def quantile(p: float) -> float:
        low, high = found[math.floor(p * last)], found[math.ceil(p * last)]
        # Equal scores stay as they are: a threshold a rounding above them would drop them all.
        return low if low == high else (math.ceil(p * last) - p * last) * low + (p * last - math.floor(p * last)) * high
    return 2 * quantile(low_share) - quantile(0.5)


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, low_share: float = LOW_SHARE) -> DataFrame:
    """Judge every document: base rules, then the likelihood ratio against a threshold.

    The threshold is 2 q - m, where m is the median and q the ``low_share``
    quantile of the scores of all trusted documents with 50 words or more. Texts that are null, empty or short
    fail the base rules; with no trusted document there is no threshold and the base rules alone decide.
    Null ids are scored like others. Extra columns of ``docs`` are ignored.
    Scores are written once; what meets the ids for the threshold are these narrow rows, not the texts.
    """
    trusted = cut_lineage(trusted_ids(labels, docs))
    scores = cut_lineage(scored(docs, fit_ratio(docs, trusted, buckets)))
    threshold = least_score(scores.where("n_words >= 50").join(trusted, "doc_id", "left_semi"), low_share)
    return (scores.withColumn("base_failed", base_failed())
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("score") >= F.lit(threshold).cast("double"), F.lit(True))))
