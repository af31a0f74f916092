"""Language identification by unigram piece models that sum over all segmentations of a word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firnline.llm.ranks import without
from firnline.llm.text import col, crc32
from firnline.session import cut_lineage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Training documents of a language at most: those with the smallest hashes. This bounds what the model is fitted on.
MAX_DOCS = 400
#: Rounds of expectation maximisation, and pseudo-count of each piece.
ROUNDS, PSEUDO = 3, 0.05
#: Longer words are scored one by one, place after place, and not learned from.
LONG = 100
#: Places of a long word that are looked up at a time.
SEGMENT = 1 << 14
#: Distinct words whose scores a task keeps.
CACHE = 400_000

MARK = "▁"
UNKNOWN = "und"
_RUNS = re.compile(r"[^\W\d_]+")
_R = np.uint64(0x9E3779B97F4A7C15)
# Probabilities are multiplied by this for each character of a piece, so that those of long words stay in range.
_SCALE = 30.0


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The lower-case pieces of letters of the public vocabulary, read where this is called (the driver)."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    fit = {p for p in found if p == p.lower() and (p.replace(MARK, "", 1).isalpha() and MARK not in p[1:])}
    return sorted(fit | {p for w in fit for p in w})


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, however long."""
    out = []
    for w in _RUNS.findall(text.lower()) if text else ():
        if not w.isalpha():
            w = "".join(c for c in w if c.isalpha())
        if w:
            out.append(w)
    return out


class Lattice:
    """All segmentations of words into pieces. Piece number ``len(pieces)`` is any unknown character, the next is none."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces) + 1
        self.none = self.size
        self.longest = max(map(len, pieces), default=1)
        self.tables = []
        for k in range(1, self.longest + 1):
            at = [i for i, p in enumerate(pieces) if len(p) == k]
            keys = np.array([self._key(pieces[i]) for i in at], np.uint64)
            order = np.argsort(keys)
            self.tables.append((keys[order], np.array(at, np.int32)[order]))

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for c in piece:
            key = (key * int(_R) + ord(c)) % (1 << 64)
        return key

    def arcs(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(length with mark, for each piece length the piece that starts at each place of each word)."""
        return self._arcs([MARK + w for w in words])

    def _arcs(self, marked: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        length = np.array([len(w) for w in marked])
        wide = int(length.max())
        codes = np.frombuffer("".join(w.ljust(wide, "\0") for w in marked).encode("utf-32-le"), "<u4").reshape(-1, wide).astype(np.uint64)
        out, key = [], np.zeros(codes.shape, np.uint64)
        for k, (keys, at) in enumerate(self.tables, 1):
            key = key[:, :wide - k + 1] * _R + codes[:, k - 1:] if wide >= k else key[:, :0]
            if not len(keys):
                out.append(np.full(key.shape, self.size - 1 if k == 1 else self.none, np.int32))
                continue
            near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out.append(np.where(keys[near] == key, at[near], self.size - 1 if k == 1 else self.none).astype(np.int32))
        return length, out

    def log_long(self, word: str, table: np.ndarray) -> np.ndarray:
        """Scaled log probability of one word in each language; holds no more than the places that a piece reaches."""
        marked = MARK + word
        ahead = np.zeros((self.longest + 1, table.shape[1]))
        ahead[0] = 1
        logs = np.zeros(table.shape[1])
        for start in range(0, len(marked), SEGMENT):
            _, arcs = self._arcs([marked[start:start + SEGMENT + self.longest - 1]])
            size = min(SEGMENT, len(marked) - start)
            pieces = np.full((size, self.longest), self.none)
            for k, a in enumerate(arcs):
                pieces[:min(size, a.shape[1]), k] = a[0, :size]
            for i in range(size):
                ahead[1:] += ahead[0] * table[pieces[i]]
                ahead[:-1] = ahead[1:]
                ahead[-1] = 0
                if i % 16 == 0:
                    most = np.maximum(ahead.max(0), 1e-300)
                    ahead /= most
                    logs += np.log(most)
        return logs + np.log(np.maximum(ahead[0], 1e-300))

    def forward(self, length: np.ndarray, arcs: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        """Scaled probability of each prefix: places x words x languages."""
        wide = int(length.max())
        alpha = np.zeros((wide + 1, len(length), table.shape[1]))
        alpha[0] = 1
        for i in range(1, wide + 1):
            for k in range(1, min(i, self.longest) + 1):
                alpha[i] += alpha[i - k] * table[arcs[k - 1][:, i - k]]
        return alpha


def _scaled(model: np.ndarray, pieces: list[str]) -> np.ndarray:
    """piece x language probabilities with the scale of each piece's length, and a last row of zeros."""
    sizes = np.array([len(p) for p in pieces] + [1])
    return np.vstack([model * (_SCALE ** sizes)[:, None], np.zeros((1, model.shape[1]))])


def _groups(words: list[str], without: set[int] = frozenset(), most: int = 5_000) -> Iterator[np.ndarray]:
    """Indices of words of similar lengths, a bounded number at a time, but for those in ``without``."""
    order = np.argsort([len(w) for w in words], kind="stable")
    if without:
        order = np.array([i for i in order.tolist() if i not in without], np.int64)
    for i in range(0, len(order), most):
        yield order[i:i + most]


def log_probabilities(words: list[str], lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, over all its segmentations."""
    out = np.zeros((len(words), table.shape[1]))
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    for i in long:
        out[i] = lattice.log_long(words[i], table) - (len(words[i]) + 1) * np.log(_SCALE)
    for at in _groups(words, set(long)):
        length, arcs = lattice.arcs([words[i] for i in at])
        alpha = lattice.forward(length, arcs, table)
        out[at] = np.log(np.maximum(alpha[length, np.arange(len(at))], 1e-300)) - length[:, None] * np.log(_SCALE)
    return out


def expected_counts(words: list[str], counts: np.ndarray, lattice: Lattice, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words of one language, by its column of ``table``."""
    total = np.zeros(lattice.size + 1)
    for at in _groups(words):
        length, arcs = lattice.arcs([words[i] for i in at])
        alpha = lattice.forward(length, arcs, table)[:, :, 0]
        n, wide = np.arange(len(at)), int(length.max())
        beta = np.zeros((wide + 1, len(at)))
        beta[length, n] = 1
        for i in range(wide - 1, -1, -1):
            for k in range(1, min(lattice.longest, wide - i) + 1):
                beta[i] += table[arcs[k - 1][:, i], 0] * beta[i + k]
        weight = counts[at] / np.maximum(alpha[length, n], 1e-300)
        for k in range(1, lattice.longest + 1):
            for i in range(wide - k + 1):
                piece = arcs[k - 1][:, i]
                total += np.bincount(piece, alpha[i] * table[piece, 0] * beta[i + k] * weight, lattice.size + 1)
    return total[:-1]


def is_held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(crc32(doc_id), F.lit(4)) == 2, F.lit(False))


def training_words(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(lang, word, n) of a bounded number of labelled documents of each language that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    # By the share of each language some four times the bound pass, so that no task has to rank a whole language.
    counts = cut_lineage(known.groupBy("lang").agg(F.count("*").alias("_all")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = known.select("doc_id", "lang").join(counts, "lang").where(place * F.col("_all") < 4 * max_docs * (1 << 30))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(place, "doc_id"))
    chosen = few.withColumn("_n", first).where(F.col("_n") <= max_docs).select("doc_id").distinct()

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                words, n = np.unique(np.array([w for w in words_of(text) if len(w) <= LONG] or [""], object).astype(str), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words.tolist(), pa.string()), pa.array(n)], ["lang", "word", "n"])
    some = known.join(F.broadcast(cut_lineage(chosen)), "doc_id", "left_semi").select("lang", "text")
    return some.mapInArrow(split, "lang string, word string, n long").where("word != ''").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, pieces: list[str], rounds: int = ROUNDS, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities of pieces by language), fitted by expectation maximisation from a uniform start.

    A round is one pass over the words; it returns a sum for each language and
    piece, which is what the driver holds.
    """
    counted = cut_lineage(training_words(docs, max_docs))
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    size = len(pieces) + 1
    model = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds if langs else 0):
        found = counted.mapInArrow(_expect(langs, pieces, model), "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(model.shape, PSEUDO)
        got = found.toPandas()
        uses[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["uses"].to_numpy()
        model = uses / uses.sum(0)
    return langs, model


def _expect(langs: list[str], pieces: list[str], model: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, table = Lattice(pieces), _scaled(model, pieces)
        for part in parts:
            lang, words, n = np.array(part.column("lang").to_pylist(), object), part.column("word").to_pylist(), part.column("n").to_numpy()
            for k, name in enumerate(langs):
                at = np.flatnonzero(lang == name)
                if len(at):
                    uses = expected_counts([words[i] for i in at], n[at].astype(float), lattice, table[:, k:k + 1])
                    piece = np.flatnonzero(uses)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), k, np.int32)), pa.array(piece.astype(np.int32)), pa.array(uses[piece])],
                                                     ["lang", "piece", "uses"])
    return run


class Scorer:
    """Scores texts; keeps the words it has met up to a bound."""

    def __init__(self, langs: list[str], pieces: list[str], model: np.ndarray):
        self.langs, self.lattice, self.table = langs, Lattice(pieces), _scaled(model, pieces)
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Summed log probabilities of the words of each text, by language."""
        if len(self.known) > CACHE:
            self.known, self.scores = {}, self.scores[:0]
        known, fresh = self.known, []
        base, at = len(known), []
        for words in texts:
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = base + len(fresh)
                    fresh.append(w)
                at.append(i)
        if fresh:
            self.scores = np.concatenate([self.scores, log_probabilities(fresh, self.lattice, self.table)])
        size = np.array([len(w) for w in texts])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.scores[at], 0)]) if at else np.zeros((1, len(self.langs)))
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]

    def judge(self, texts: list[list[str]]) -> tuple[list[str], np.ndarray]:
        """Best language of each text and its share of the likelihood of all; UNKNOWN and 0 without words."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = self.sums(texts)
        best = found.argmax(1)
        share = 1 / np.exp(found - found.max(1, keepdims=True)).sum(1)
        empty = np.array([not w for w in texts], bool)
        return [UNKNOWN if e else self.langs[b] for b, e in zip(best, empty)], np.where(empty, 0.0, share)


def _judge(langs: list[str], pieces: list[str], model: np.ndarray, text_col: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(langs, pieces, model)
        for part in parts:
            pred, score, held, size = [], [], [], 0
            for t in part.column(text_col):
                held.append(words_of(t.as_py()))
                size += len(held[-1])
                if size >= 300_000:
                    p, s = scorer.judge(held)
                    pred, score, held, size = pred + p, score + s.tolist(), [], 0
            if held:
                p, s = scorer.judge(held)
                pred, score = pred + p, score + s.tolist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*part.schema.names, "lang_pred", "score"])
    return run


def with_language(docs: DataFrame, vocabulary: str = VOCABULARY, max_docs: int = MAX_DOCS) -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced); see ``identify``."""
    known = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"), col(docs, "lang").alias("lang"))
    pieces = load_pieces(vocabulary)
    langs, model = fit(known, pieces, max_docs=max_docs)
    kept = without(docs, "lang_pred", "score")
    # Plain names inside, since a name with a dot can't pass.
    plain = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    text_col = plain.columns[[c.lower() for c in kept.columns].index("text")]
    return plain.mapInArrow(_judge(langs, pieces, model, text_col), schema).toDF(*kept.columns, "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is UNKNOWN."""
    found = with_language(docs)
    return found.where(F.col("lang_pred") != UNKNOWN).select(*[col(found, c) for c in docs.columns if c.lower() not in ("lang_pred", "score")])


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    Learns from documents with a lang whose id's CRC-32 modulo 4 is not 2;
    predicts from the text alone. The score is the best language's share of
    the likelihoods. A text that is null or without a letter is ``und`` with
    score 0, as is every text if nothing could be learned. Null ids are never
    held out nor learned from; repeated rows get a result each; other columns
    are ignored.
    """
    found = with_language(docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"), col(docs, "lang").alias("lang")),
                          vocabulary, max_docs)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
