"""Language identification by words first, then ever shorter character n-grams.

A word that the model knows adds its log frequency in each language. Of an
unseen word the longest order of n-grams of which the model knows any counts:
the mean of their log frequencies, from 4 characters down to 1. The language
with the largest sum wins; the score is its share after softmax.

The model is learned from labelled rows: all of them, or about ``TRAIN_ROWS``
chosen by a hash of doc_id where there are more, an equal share of each
language as far as it has so many. It keeps the ``MOST_WORDS`` most frequent words and ``MOST_GRAMS`` n-grams of
each order, again an equal share by language, so its size does not grow with the
corpus and no language crowds another out. doc_id decides which rows may be learned from, and
is never an input of a prediction; nor are lang and source.

Rules. A text that is null or has no letter is ``und`` with score 0, and so is
every text if there is nothing to learn from. Whole texts of any length are
read. An empty table gives an empty result and a model that knows no language. Ties go to
the language that sorts first. Rows with a null doc_id are predicted, not
learned from. Repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .batches import map_rows, slices, small_batches
from .workers import clear, keep

#: Bound of the sample of labelled rows that the model is fitted on.
TRAIN_ROWS = 12_000
#: Sizes of the model.
MOST_WORDS, MOST_GRAMS, ORDERS = 50_000, 15_000, (4, 3, 2, 1)
#: Words that a worker keeps the scores of.
REMEMBER = 400_000
#: A prediction below this is rejected by ``reject_unknown``, for texts of enough words to judge.
LEAST_SCORE, LEAST_WORDS = 0.5, 10

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case words of letters."""
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def grams(word: str, order: int) -> list[str]:
    padded = f"^{word}$" if order > 1 else word
    return [padded[k : k + order] for k in range(len(padded) - order + 1)]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words (order 0) and n-grams by language, as far as this task has seen."""
    clear()
    for pdf in batches:
        seen: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            seen[lang, 0].update(words_of(text))
        for lang in {k for k, _ in seen}:
            for word, n in seen[lang, 0].items():
                for order in ORDERS:
                    for g in grams(word, order):
                        seen[lang, order][g] += n
        rows = [(lang, order, g, n) for (lang, order), c in seen.items() for g, n in c.items()]
        yield pd.DataFrame(rows, columns=["lang", "order", "gram", "n"])


class Model:
    """Log frequencies by language of known words and n-grams; smoothed by half an occurrence."""

    def __init__(self, langs: list[str], tables: dict[int, dict[str, np.ndarray]]):
        self.langs, self.tables, self.key = langs, {}, uuid.uuid4().hex
        for order, counts in tables.items():
            total = sum(counts.values(), np.zeros(len(langs))) + 0.5 * (len(counts) + 1)
            self.tables[order] = {g: np.log((c + 0.5) / total).astype(np.float32) for g, c in counts.items()}

    def word(self, word: str) -> np.ndarray:
        known = self.tables.get(0, {}).get(word)
        if known is not None:
            return known
        for order in ORDERS:
            table = self.tables.get(order, {})
            found = [table[g] for g in grams(word, order) if g in table]
            if found:
                return np.mean(found, axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Predicts texts, keeping the scores of words that it has met."""

    def __init__(self, model: Model, remember: int = REMEMBER):
        self.model, self.remember = model, remember
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not self.model.langs or not any(w.isalpha() or any(c.isalpha() for c in w) for w in words):
            return "und", 0.0
        index = self.index
        new = [*set(words).difference(index)]
        for w in new:
            if len(index) == len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[len(index)] = self.model.word(w)
            index[w] = len(index)
        at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        total = self.rows[at].sum(axis=0, dtype=np.float64)
        if len(index) > self.remember:  # full: the last ones go again
            for w in new:
                del index[w]
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def learnable(doc_id: Column) -> Column:
    """Whether a row may be learned from: its crc32 modulo 4 is not 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _sample(labelled: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` rows at most, as many of each language as it has and its share allows."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many as languages
    if sum(sizes.values()) <= rows:
        return labelled
    left, open_, share = rows, sorted(sizes, key=lambda k: (sizes[k], k)), {}
    for k, lang in enumerate(open_):  # what a small language leaves goes to the larger ones
        share[lang] = min(sizes[lang], left // (len(open_) - k))
        left -= share[lang]
    kept = labelled.sparkSession.createDataFrame([(k, int(1_000_000 * share[k] / sizes[k])) for k in open_], "lang string, share long")
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1_000_000)) < F.col("share")
    return labelled.join(kept, "lang").where(chosen).select(labelled.columns)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, most_words: int = MOST_WORDS, most_grams: int = MOST_GRAMS) -> Model:
    """A model of the labelled documents that may be learned from."""
    labelled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where(learnable(F.col("doc_id")) & F.col("lang").isNotNull())
    counted = _sample(labelled, rows).where("text IS NOT NULL").select("lang", "text").mapInPandas(_count, "lang string, order int, gram string, n long")
    by_lang = counted.groupBy("order", "gram", "lang").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        by_lang = Scratch(docs.sparkSession, "language").keep(by_lang, "grams")
    langs = sorted(r[0] for r in by_lang.select("lang").distinct().collect())
    place = {lang: k for k, lang in enumerate(langs)}
    ranked = Window.partitionBy("order", "lang").orderBy(F.desc("n"), "gram")
    most = F.when(F.col("order") == 0, most_words).otherwise(most_grams)
    # A top-k of each order and language, so nothing is sorted as a whole, and one order is on the driver at a time.
    frequent = by_lang.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= F.ceil(most / max(1, len(langs)))).select("order", "gram").distinct()
    tables: dict[int, dict[str, np.ndarray]] = {order: {} for order in (0, *ORDERS)}
    held = Scratch(docs.sparkSession, "language").keep(by_lang.join(frequent, ["order", "gram"], "left_semi"), "model")
    for order in (0, *ORDERS):
        for r in held.where(F.col("order") == order).select("gram", "lang", "n").toLocalIterator():
            tables[order].setdefault(r["gram"], np.zeros(len(langs), np.float32))[place[r["lang"]]] = r["n"]
    return Model(langs, tables)


def _predict(batches: Iterator[pd.DataFrame], model, key: str) -> Iterator[pd.DataFrame]:
    scorer = keep(("language", key), lambda: Scorer(model.value))
    for pdf in slices(batches):
        found = [scorer.predict(t) for t in pdf["text"]]
        yield pdf[["doc_id", "held_out"]].assign(lang_pred=[x for x, _ in found], score=[x for _, x in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string"))
    return map_rows(rows, partial(_predict, model=shared, key=model.key), "doc_id long, held_out boolean, lang_pred string, score double", "doc_id")


def reject_unknown(docs: DataFrame, model: Model, least: float = LEAST_SCORE, words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without texts that have no letter, and those of at least so many words of which no language in particular is likely; the columns stay as they are.

    A model that knows no language rejects for want of a letter only.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), model.key

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = keep(("language", key), lambda: Scorer(shared.value))

        def passes(text: str | None) -> bool:
            lang, score = scorer.predict(text)
            if lang == "und":
                return not shared.value.langs and bool(words_of(text))
            return score >= least or len(words_of(text)) < words

        for texts in batches:
            yield pd.Series([passes(t) for t in texts], dtype=bool)

    return docs.where(known(docs["text"].cast("string")))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
