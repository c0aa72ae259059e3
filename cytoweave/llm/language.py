"""Language identification: known words first, character n-grams for the rest.

A word that was learned is scored by its log frequency in every language.  A word that
was not is scored by its longest learned character n-grams: first those of ``max_n``
characters, then one less, until some are known.  A text sums its words.

The model is fitted on a keyed sample of about ``per_language`` labelled documents of each
language (a documented bound: the model is sent to every worker); prediction reads all
documents and whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, record_batch

PER_LANGUAGE = 1000
MAX_N = 5
MIN_COUNT = 2
MAX_LANGUAGES = 1000
# evidence of a long text counts as that of so many average words
FULL_WORDS = 20
CACHE_WORDS = 100_000
WORDS = re.compile(r"[^\W\d_]+")
COUNTS = "lang string, n int, gram string, count bigint"


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORDS.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams with the word's ends marked."""
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Places:
    """Where each of many different strings stands: hashes in order and the strings as one Arrow column, no object for each.

    Every worker holds a model; as a dictionary it took most of a worker's memory.
    """

    def __init__(self, names: list[str]):
        self.seed = 0
        while len(np.unique(hashes := self._hashes(names))) < len(names):
            self.seed += 1
        order = np.argsort(hashes)
        self.hashes, self.row = hashes[order], order.astype(np.int32)
        self.names = pa.array(names, pa.large_string())

    def _hashes(self, names: list[str]) -> np.ndarray:
        return np.array([xxhash.xxh3_64_intdigest(n, self.seed) for n in names], dtype=np.uint64)

    def find(self, names: list[str]) -> list[int]:
        """The place of every name, -1 for one that is not held."""
        if not len(self.hashes):
            return [-1] * len(names)
        hashes = self._hashes(names)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        rows = np.where(self.hashes[at] == hashes, self.row[at], -1).tolist()
        return [row if row >= 0 and self.names[row].as_py() == name else -1 for row, name in zip(rows, names)]


class Model:
    """Log frequencies: ``tables[0]`` of words, ``tables[n]`` of n-grams; one value per language."""

    def __init__(self, langs: list[str], counts: dict[int, dict[str, np.ndarray]], max_n: int):
        self.langs, self.max_n = langs, max_n
        self.tables = [self._logs(counts.get(n, {})) for n in range(max_n + 1)]

    def _logs(self, counts: dict[str, np.ndarray]) -> tuple[Places, np.ndarray]:
        rows = np.array(list(counts.values()), dtype=np.float64).reshape(len(counts), len(self.langs))
        logs = np.log((rows + 0.5) / (rows.sum(axis=0) + 0.5 * max(len(rows), 1)))
        return Places(list(counts)), logs.astype(np.float32)

    def score_words(self, words: list[str]) -> list[np.ndarray]:
        index, logs = self.tables[0]
        return [logs[at] if at >= 0 else self._by_grams(word) for word, at in zip(words, index.find(words))]

    def _by_grams(self, word: str) -> np.ndarray:
        for n in range(self.max_n, 0, -1):
            index, logs = self.tables[n]
            known = [at for at in index.find(grams_of(word, n)) if at >= 0]
            if known:
                return logs[known].mean(axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)


class Predictor:
    """A model with a bounded memory of the words it has scored."""

    def __init__(self, model: Model, cache_words: int = CACHE_WORDS):
        self.model, self.cache_words = model, cache_words
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.matrix = np.zeros((0, len(self.model.langs)), dtype=np.float32)
        self.filled = 0

    def _learn(self, words: list[str]) -> None:
        self.index.update(zip(words, range(len(self.rows), len(self.rows) + len(words))))
        self.rows += self.model.score_words(words)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.model.langs:
            return "und", 0.0
        counts = Counter(words_of(text))
        if not any(c.isalpha() for w in counts for c in w):
            return "und", 0.0
        if len(self.index) > self.cache_words:
            self._clear()
        if new := [w for w in counts if w not in self.index]:
            self._learn(new)
        ids = [self.index[w] for w in counts]
        if len(self.rows) > len(self.matrix):  # grown by doubling, so copies stay few
            more = np.zeros((max(2 * len(self.rows), 1024), len(self.model.langs)), dtype=np.float32)
            more[: len(self.rows)] = self.rows
            self.matrix, self.filled = more, len(self.rows)
        elif len(self.rows) > self.filled:
            self.matrix[self.filled : len(self.rows)] = self.rows[self.filled :]
            self.filled = len(self.rows)
        weights = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
        mean = weights @ self.matrix[ids] / weights.sum()
        evidence = mean * min(weights.sum(), FULL_WORDS)
        shares = np.exp(evidence - evidence.max())
        best = int(np.argmax(mean))  # the first language in order wins a tie
        return self.model.langs[best], float(shares[best] / shares.sum())


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, seed: int = 0) -> DataFrame:
    """Keyed sample ``(text, lang)`` of about ``per_language`` documents of each language."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in bounded_rows(known.groupBy("lang").count(), MAX_LANGUAGES, "languages")}
    if not sizes:
        return known.select("text", "lang").limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return known.where(draw < share[F.col("lang")]).select("text", "lang")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, max_n: int = MAX_N, min_count: int = MIN_COUNT) -> Model:
    """Learn word and n-gram frequencies from ``docs(doc_id, text, lang)``; null text or lang teaches nothing."""

    def count(batches):
        held: Counter = Counter()
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, times in Counter(words_of(text)).items():
                    held[lang, 0, word] += times
                    for n in range(1, max_n + 1):
                        for gram in grams_of(word, n):
                            held[lang, n, gram] += times
            if len(held) > CACHE_WORDS:
                yield from emit(held)
                held = Counter()
        yield from emit(held)

    def emit(held):
        if held:
            yield record_batch(COUNTS, [*map(list, zip(*held)), list(held.values())])

    total = sample(docs, per_language).mapInArrow(count, COUNTS).groupBy("n", "gram", "lang").agg(F.sum("count").alias("count"))
    by_gram = total.groupBy("n", "gram").agg(F.sum("count").alias("_all"), F.map_from_entries(F.collect_list(F.struct("lang", "count"))).alias("by")).where(F.col("_all") >= min_count)
    rows = by_gram.select("n", "gram", "by").toArrow().sort_by([("n", "ascending"), ("gram", "ascending")])
    found: dict[int, dict[str, np.ndarray]] = {}
    langs: list[str] = sorted({lang for by in rows.column("by").to_pylist() for lang, _ in by})
    at = {lang: i for i, lang in enumerate(langs)}
    for n, gram, by in zip(rows.column("n").to_pylist(), rows.column("gram").to_pylist(), rows.column("by").to_pylist()):
        row = found.setdefault(n, {})[gram] = np.zeros(len(langs), dtype=np.float32)
        for lang, times in by:
            row[at[lang]] = times
    return Model(langs, found, max_n)


def predict(docs: DataFrame, model: Model, into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into(lang_pred, score)``; one row in, one row out.

    ``und`` with score 0 for null texts, texts without a letter, and when nothing was learned.
    Only ``text`` is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = Predictor(shared.value)
        for texts in batches:
            found = [predictor.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(into, run(F.col("text")))
