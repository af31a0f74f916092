"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.rows import with_row_key, without_keys
from firnline.llm.text import col
from firnline.llm.windows import batches, letter_words, mix, pieces
from firnline.session import cut_lineage

#: Words of a window. Items with fewer words are one window of their own length.
WINDOW = 10

_PRINTS = pa.schema([("doc", pa.int64()), ("t", pa.int32()), ("hash", pa.int64()), ("place", pa.int32())])
_SPANS = pa.schema([("doc", pa.int64()), ("t", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int32())])


def gram_of(t: int) -> int:
    """Words of the hashed grams that find spans of t words: with windows of t - k + 1 grams each span keeps one."""
    return (t + 1) // 2


def winnow(words, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the smallest gram of every t consecutive words of one text, each once.

    Equal spans of t words keep the same gram wherever they stand, so two texts
    that share such a span share a kept hash.
    """
    k = gram_of(t)
    width = t - k + 1
    if len(words.start) < t:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = mix(words.hashes(k), t)
    shifted = [grams[i:len(grams) - width + 1 + i] for i in range(width)]
    least, at = shifted[0].copy(), np.arange(len(shifted[0]))
    for i in range(1, width):
        better = shifted[i] < least
        least[better] = shifted[i][better]
        at[better] = np.flatnonzero(better) + i
    keep = np.zeros(len(grams), bool)
    keep[at[words.left[:len(at)] >= t]] = True
    found = np.flatnonzero(keep)
    return found, grams[found]


def _prints(lengths: list[int]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                ids = part.column("doc")
                for first, words in pieces(part.column("text"), letter_words):
                    for t in lengths:
                        at, hashes = winnow(words, t)
                        if len(at):
                            yield {"doc": ids.take(pa.array(first + words.doc[at])), "t": np.full(len(at), t, np.int32),
                                   "hash": hashes.view(np.int64), "place": words.place[at].astype(np.int32)}
        yield from batches(rows(), _PRINTS)
    return run


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        n = [x.count(b" ") + 1 if (x := letter_words(t.as_py() or b"")) else 0 for t in part.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("id"), pa.array(n, pa.int64())], ["doc", "id", "n_words"])


def _item_windows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item."""
    def rows():
        for part in parts:
            ids = part.column("doc")
            for first, words in pieces(part.column("text"), letter_words):
                size = np.minimum(words.counts[words.doc], WINDOW)
                for t in np.unique(size).tolist():
                    at = np.flatnonzero((size == t) & (words.left >= t))
                    h = words.exact(at, t)
                    yield {"doc": ids.take(pa.array(first + words.doc[at])), "t": np.full(len(at), t, np.int32), "h1": h[:, 0], "h2": h[:, 1],
                           "place": words.place[at].astype(np.int32)}
    yield from batches(rows(), _SPANS)


def _spans_around(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each matched gram of a document, extended to the windows that contain it."""
    def rows():
        for part in parts:
            ids = part.column("doc")
            hits = part.column("hits")
            for first, words in pieces(part.column("text"), letter_words):
                wanted: dict[int, list[np.ndarray]] = {}
                for i in range(len(words.counts)):
                    for hit in hits[first + i].as_py():
                        t, place = hit["t"], hit["place"]
                        low, high = max(0, place - (t - gram_of(t))), min(place, int(words.counts[i]) - t)
                        wanted.setdefault(t, []).append(words.first[i] + np.arange(low, high + 1))
                for t, at in wanted.items():
                    at = np.unique(np.concatenate(at))
                    h = words.exact(at, t)
                    yield {"doc": ids.take(pa.array(first + words.doc[at])), "t": np.full(len(at), t, np.int32), "h1": h[:, 0], "h2": h[:, 1],
                           "place": words.place[at].astype(np.int32)}
    yield from batches(rows(), _SPANS)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Documents and items keep winnowed grams; a join on them gives candidate
    places, and only windows around those are compared, by 128-bit hashes.
    Null, empty and wordless texts have no words and are clean; so is every
    document if there are no items. Items with equal windows all count. Rows
    are told apart by a key of their own, so each is judged by its own text,
    whether its id is null or another's too. Null item_ids are left out of the
    item list.
    """
    keyed = with_row_key(docs, "_row")
    rows = keyed.select(F.col("_row").alias("doc"), col(keyed, id_col).cast("long").alias("id"), col(keyed, text_col).alias("text"))
    return _judged(rows, benchmark, item_col, item_text_col).select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _judged(rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``contamination`` of ``rows(doc, id, text)`` with both doc, a key, and id."""
    texts = rows.select("doc", "text")
    items = benchmark.select(col(benchmark, item_col).alias("item"), col(benchmark, item_text_col).alias("text"))
    items = cut_lineage(items.select(F.monotonically_increasing_id().alias("doc"), "item", "text"))
    windows = cut_lineage(items.select("doc", "text").mapInArrow(_item_windows, "doc long, t int, h1 long, h2 long, place int")
                          .select("doc", "t", "h1", "h2").distinct())
    lengths = sorted(r.t for r in windows.select("t").distinct().collect())  # at most WINDOW numbers
    if not lengths:
        found = rows.mapInArrow(_counts, "doc long, id long, n_words long")
        return _result(found.withColumn("n_hit", F.lit(None).cast("long")).withColumn("n_items", F.lit(None).cast("long"))
                       .withColumn("items_sha256", F.lit(None).cast("string")))
    schema = "doc long, t int, hash long, place int"
    # An item shorter than the window only counts as a whole, so its grams are those of its own length.
    counted = items.join(windows.groupBy("doc").agg(F.max("t").alias("own")), "doc")
    known = cut_lineage(counted.select("doc", "text").mapInArrow(_prints(lengths), schema)
                        .join(counted.select("doc", "own"), "doc").where("t = own").select("t", "hash").distinct())
    hits = (texts.mapInArrow(_prints(lengths), schema).join(known, ["t", "hash"], "left_semi")
            .groupBy("doc").agg(F.collect_set(F.struct("t", "place")).alias("hits")))
    hits = cut_lineage(hits)
    around = (texts.join(hits, "doc").select("doc", "text", "hits")
              .mapInArrow(_spans_around, "doc long, t int, h1 long, h2 long, place int"))
    # Windows are grouped by the items they belong to, so that a passage of many items is one row and not one for each.
    sets = (windows.join(items.select("doc", "item"), "doc").groupBy("t", "h1", "h2")
            .agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("of")))
    sets = cut_lineage(sets.withColumn("set", F.sha2(F.to_json("of"), 256)))
    spans = cut_lineage(around.join(sets.select("t", "h1", "h2", "set"), ["t", "h1", "h2"]).select("doc", "t", "place", "set"))
    per_doc = spans.groupBy("doc").agg(F.collect_set(F.struct("t", "place")).alias("spans"),
                                       F.array_sort(F.collect_set("set")).alias("sets"))
    words_hit = F.size(F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s["place"], s["place"] + s["t"] - 1)))))
    per_doc = cut_lineage(per_doc.select("doc", words_hit.cast("long").alias("n_hit"), "sets"))
    # Documents with the same sets share their list of items, which is made once.
    lists = (per_doc.select("sets").distinct().select("sets", F.explode("sets").alias("set"))
             .join(sets.select("set", "of").distinct(), "set").select("sets", F.explode("of").alias("item")).distinct()
             .groupBy("sets").agg(F.count("*").alias("n_items"),
                                  F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("item"))), 256).alias("items_sha256")))
    judged = per_doc.join(lists, "sets").drop("sets")
    counted = rows.mapInArrow(_counts, "doc long, id long, n_words long")
    return _result(counted.join(judged, "doc", "left"))


def _result(found: DataFrame) -> DataFrame:
    none = F.sha2(F.lit("").cast("binary"), 256)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select("doc", "id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                        F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def uncontaminated_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose own text shares a window with the benchmark, whatever their ids. An empty table stays empty."""
    keyed = with_row_key(docs, "_row")
    rows = keyed.select(F.col("_row").alias("doc"), F.lit(None).cast("long").alias("id"), col(keyed, "text").alias("text"))
    bad = _judged(rows, benchmark).where("contaminated").select(F.col("doc").alias("_row"))
    return without_keys(keyed, "_row", cut_lineage(bad)).drop("_row")
