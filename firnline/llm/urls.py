"""URL rules, and a ratio of character models for the URLs that no rule decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.text import col, crc32
from firnline.session import cut_lineage

#: (verdict, host, path). A rule fits its host and all subdomains for paths that start with its own; the longest wins.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Characters of context at most.
ORDER = 4
#: Probability of any character without context or evidence: one in this many.
SYMBOLS = 256
#: Steps of the threshold in one unit of score.
STEPS = 100

START, END = "^", "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a URL; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. ``rules`` is a short list, not a table."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def grams(text: Column) -> Column:
    """Every character of a URL with the ORDER before it, start and end marked."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))


def gram_ratios(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, ratio) for the grams of ``wanted``: log probability ratio of its last character, in whole millionths.

    ``counted`` has (gram, good, bad), the uses in accepted and in rejected
    URLs. In each class the estimate of a longer context is interpolated with
    that of the next shorter one by the number of different characters seen
    after it (Witten and Bell 1991), down to a uniform one.
    """
    now = wanted.select("gram", F.lit(1 / SYMBOLS).alias("p_good"), F.lit(1 / SYMBOLS).alias("p_bad"))
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        seen = counted.groupBy(tail.alias("tail")).agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"))
        context = seen.groupBy(F.substring("tail", 1, k).alias("context")).agg(
            *[f(c).alias(a) for c in ("good", "bad") for f, a in (
                (lambda c: F.sum(f"n_{c}"), f"all_{c}"), (lambda c: F.count(F.when(F.col(f"n_{c}") > 0, 1)), f"kinds_{c}"))])
        joined = now.withColumn("tail", tail).withColumn("context", F.substring("tail", 1, k))
        joined = joined.join(seen, "tail", "left").join(context, "context", "left")

        def better(c: str) -> Column:
            p = F.col(f"p_{c}")
            blend = (F.coalesce(F.col(f"n_{c}"), F.lit(0)) + F.col(f"kinds_{c}") * p) / (F.col(f"all_{c}") + F.col(f"kinds_{c}"))
            return F.when(F.col(f"all_{c}") > 0, blend).otherwise(p)
        now = joined.select("gram", better("good").alias("p_good"), better("bad").alias("p_bad"))
    return now.select("gram", F.round((F.log("p_good") - F.log("p_bad")) * 1e6).cast("long").alias("ratio"))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages``.

    The rules' own URLs train the models: allowed ones are accepted, blocked
    ones rejected; a fourth of them, by hash, is left out and sets the
    threshold with the best balanced accuracy. Without such URLs it is 0. The
    score is the mean log ratio over a URL's characters, by host and path. A
    null URL, or one without ``://``, has empty parts, fits no rule and is
    scored as an empty text. Repeated rows get a result each.
    """
    host, path = host_and_path(col(pages, url_col))
    rows = pages.select(col(pages, id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("text", F.concat("host", "path"))
    # Equal URLs are one row with a weight from here on.
    texts = cut_lineage(rows.groupBy("text").agg(
        F.count(F.when(F.col("found.verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("found.verdict") == "block", 1)).alias("bad"))
        .withColumn("calibrates", F.pmod(crc32(F.col("text")), F.lit(4)) == 2))
    spread = texts.select("text", "good", "bad", "calibrates", F.explode(grams(F.col("text"))).alias("gram"))
    trains = F.when(~F.col("calibrates"), 1).otherwise(0)
    counted = cut_lineage(spread.groupBy("gram").agg(F.sum(F.col("good") * trains).alias("good"), F.sum(F.col("bad") * trains).alias("bad")))
    ratios = cut_lineage(gram_ratios(counted.where("good + bad > 0"), counted))
    scores = spread.join(ratios, "gram").groupBy("text", "good", "bad", "calibrates").agg((F.sum("ratio") / (F.count("*") * 1e6)).alias("score"))
    scores = cut_lineage(scores)
    limit = threshold(scores.where("calibrates")).scalar()
    verdict = F.when(F.col("score") >= F.coalesce(limit, F.lit(0.0)), "allow").otherwise("block")
    return rows.join(scores.select("text", "score"), "text").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), verdict).alias("verdict"), "score")


def threshold(scores: DataFrame) -> DataFrame:
    """One number: the lowest step with the most balanced accuracy over (score, good, bad); null without both kinds.

    Scores are counted by step first; as ratios are bounded, so are the steps.
    """
    steps = scores.groupBy(F.floor(F.col("score") * STEPS).alias("step")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    below, every = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    gains = steps.select("step", (F.coalesce(F.sum("bad").over(below), F.lit(0)) * F.sum("good").over(every)
                                  - F.coalesce(F.sum("good").over(below), F.lit(0)) * F.sum("bad").over(every)).alias("gain"),
                         (F.least(F.sum("good").over(every), F.sum("bad").over(every)) > 0).alias("both")).where("both")
    return gains.agg((F.min_by("step", F.struct(-F.col("gain"), F.col("step"))) / STEPS).alias("limit"))
