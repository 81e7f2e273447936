"""Language identification by word-first backoff (operator 1).

A known word scores by its log frequency in each language. A word seen in no language
falls back to its character n-grams, the longest length of which any is known, and so on
down to single letters; what is unknown even there says nothing.

The model is learnt from labelled rows by Spark and is small by its parameters:
``max_words`` words a language and ``max_grams`` n-grams of each length a language, learnt
from a sample of about ``sample_docs`` labelled documents a language chosen by a hash of
their id. It goes to the executors as one broadcast of that bounded size; every text of the
corpus is then scored where it lies, without a shuffle.

Defined cases: a text that is null or without a letter is ``und`` with score 0; without
any labelled text, so is every row; ties go to the language first in order; repeated rows
are scored each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import tidy

UNKNOWN = "und"
SAMPLE_DOCS = 3000
MAX_WORDS = 20_000
MAX_GRAMS = 4_000
LONGEST = 5
#: Words that a worker remembers between texts.
CACHE_WORDS = 200_000
#: Grams of this length tell words from gibberish, once a model knows enough of them.
KNOWN_GRAM, ENOUGH_GRAMS = 3, 500
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if len(marked) > n else [marked]


@tidy
def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n), summed within the task up to a bound."""
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                held[lang, w] += n
        if len(held) > 500_000:
            yield out()
            held.clear()
    yield out()


class Model:
    """Log frequencies: known words, and n-grams by their length."""

    def __init__(self, counts: dict[str, dict[str, int]], longest: int = LONGEST, max_grams: int = MAX_GRAMS):
        self.langs = sorted(counts)
        self.longest = longest
        self.words = self._logs(counts)
        self.grams: dict[int, dict[str, np.ndarray]] = {}
        for n in range(1, longest + 1):
            tables = {}
            for lang, words in counts.items():
                sums: Counter = Counter()
                for w, c in words.items():
                    for g in grams_of(w, n):
                        sums[g] += c
                tables[lang] = dict(sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:max_grams])
            self.grams[n] = self._logs(tables)

    def _logs(self, counts: dict[str, dict[str, int]]) -> dict[str, np.ndarray]:
        every = sorted({w for words in counts.values() for w in words})
        out = np.empty((len(every), len(self.langs)), dtype=np.float32)
        for j, lang in enumerate(self.langs):
            total = sum(counts[lang].values()) + 0.5 * (len(every) + 1)
            out[:, j] = [np.log((counts[lang].get(w, 0) + 0.5) / total) for w in every]
        return dict(zip(every, out, strict=True))

    def score_word(self, word: str) -> np.ndarray:
        if (s := self.words.get(word)) is not None:
            return s
        for n in range(self.longest, 0, -1):
            if known := [s for g in grams_of(word, n) if (s := self.grams[n].get(g)) is not None]:
                return np.mean(known, axis=0)
        return np.zeros(len(self.langs), dtype=np.float32)


    def known_grams(self, word: str) -> tuple[int, int]:
        """How many grams of a word were learnt in any language, of how many; scripts
        without case, whose words are seldom parted, go by single letters. A model that
        has learnt little knows all."""
        n = min(KNOWN_GRAM, self.longest) if word.upper() != word else 1
        grams = grams_of(word, n)
        if len(self.grams[min(KNOWN_GRAM, self.longest)]) < ENOUGH_GRAMS:
            return len(grams), len(grams)
        return sum(g in self.grams[n] for g in grams), len(grams)


class _Scores(dict):
    """word -> row of a score table, filled when a word is first met; begun anew when full."""

    def __init__(self, model: Model, size: int):
        super().__init__()
        self.model, self.rows = model, np.empty((size, len(model.langs)), dtype=np.float32)
        self.grams: dict[str, tuple[int, int]] = {}

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.rows):  # one text has more words: grow for it
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[k] = self.model.score_word(word)
        self[word] = k
        return k

    def share(self, words: list[str]) -> float:
        """The share of known grams in the words of a text."""
        for w in words:
            if w not in self.grams:
                self.grams[w] = self.model.known_grams(w)
        return sum(self.grams[w][0] for w in words) / sum(self.grams[w][1] for w in words)


def _predictor(shared, cache_words: int, with_share: bool):
    @tidy
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Scores(model, cache_words) if model else None
        for batch in batches:
            langs, scores, shares = [], [], []
            for text in batch.column(2).to_pylist():
                lang, score, share = UNKNOWN, 0.0, 0.0
                if known is not None and text and any(map(str.isalpha, text)):
                    if len(known) > cache_words * 3 // 4:
                        known = _Scores(model, cache_words)
                    words = words_of(text)
                    if rows := [known[w] for w in words]:
                        mean = known.rows[rows].mean(axis=0, dtype=np.float64)
                        best = int(mean.argmax())
                        lang, score = model.langs[best], float(1 / np.exp(mean - mean[best]).sum())
                        share = known.share(words) if with_share else share
                langs.append(lang)
                scores.append(score)
                shares.append(share)
            more = [pa.array(shares, pa.float64())] if with_share else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), batch.column(3), *more], names=["doc_id", "held_out", "lang_pred", "score", "text_hash", "known"][: 5 + len(more)])

    return run


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, longest: int = LONGEST) -> Model | None:
    """A model of ``labelled`` (doc_id, lang, text); None without any word."""
    rows = labelled.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a label
    if not n_docs:
        return None
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1_000_000))
    take = F.lit(False)
    by_share = defaultdict(list)
    for lang, n in n_docs.items():
        by_share[min(1_000_000, -(-sample_docs * 1_000_000 // n))].append(lang)
    for share, langs in sorted(by_share.items()):
        take = take | (F.col("lang").isin(langs) & (part < share))
    counted = rows.filter(take).select("lang", "text").mapInArrow(_count, "lang string, word string, n bigint")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max_words)
    counts: dict[str, dict[str, int]] = {}
    for r in top.select("lang", "word", "n").toLocalIterator():
        counts.setdefault(r.lang, {})[r.word] = r.n
    return Model(counts, longest, max_grams) if counts else None


def held_out_rows() -> Column:
    """The rows kept out of learning: crc32 of the id as text is 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model | None, cache_words: int = CACHE_WORDS, with_share: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out_rows().alias("held_out"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(_predictor(shared, cache_words, with_share), "doc_id bigint, held_out boolean, lang_pred string, score double, text_hash bigint" + ", known double" * with_share)


def identify(docs: DataFrame, with_share: bool = False, **params) -> DataFrame:
    """doc_id, held_out, lang_pred, score, text_hash (Spark's xxhash64) of every row of
    ``docs`` (doc_id, text, lang); ``with_share`` adds known, the share of its grams that
    the model knows."""
    return predict(docs, fit(docs.filter(~held_out_rows() & F.col("doc_id").isNotNull()), **params), with_share=with_share)
