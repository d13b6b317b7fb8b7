"""Language ID, word first: known words by their log frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import checked_broadcast, small_batches, worker_cache

#: Documents of each language in the bounded sample that the model is fitted on (a language with fewer gives all), and the
#: longest n-gram that unseen words back off to.
SAMPLE_DOCS = 1000
MAX_N = 5
#: Words beyond the model's own whose scores a worker keeps; and how many words like a text's average word a score is the posterior of. It is the
#: same for all texts, so a score means the same whatever the length.
CACHE = 100_000
SHARPNESS = 10
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
#: A code page of Western letters and marks: texts in it are cut into words as bytes, of which all but letters become spaces.
PAGE = "cp1252"
LETTERS = bytes(b if WORD.fullmatch(bytes([b]).decode(PAGE, "replace")) else 32 for b in range(256))
#: Characters of a text that are cut into words at once.
LONG = 1 << 20


def word_counts(text: str) -> Counter:
    """The lower-case words of a text, each with its count; of a very long one, only those of its distinct words are held."""
    text = text.lower()
    if len(text) > LONG:
        return Counter(w[0] for w in WORD.finditer(text))
    try:
        return Counter(text.encode(PAGE).translate(LETTERS).decode(PAGE).split())
    except UnicodeEncodeError:
        return Counter(WORD.findall(text))


class Model:
    """Log frequencies by language of words and of the n-grams of <word>, as plain dictionaries to rows of a matrix."""

    def __init__(self, counts: list[tuple[str, str, int]], max_n: int = MAX_N):
        self.langs, self.max_n = sorted({c[0] for c in counts}), max_n
        words: dict = {}
        grams: list[dict] = [{} for _ in range(max_n + 1)]
        for at, lang in enumerate(self.langs):
            own: list[dict] = [defaultdict(int) for _ in range(max_n + 1)]
            for of, word, n in counts:
                if of == lang:
                    words.setdefault(word, [0] * len(self.langs))[at] += n
                    whole = f"<{word}>"
                    for m in range(1, max_n + 1):
                        seen = own[m]
                        for i in range(len(whole) + 1 - m):
                            seen[whole[i : i + m]] += 1
            for table, seen in zip(grams, own):
                for g, k in seen.items():
                    if g not in table:
                        table[g] = [0] * len(self.langs)
                    table[g][at] = k
        self.evidence: Evidence | None = None  # a worker's
        self.words = self._logs({w: c for w, c in words.items() if sum(c) > 1})
        self.grams = [self._logs({g: c for g, c in t.items() if sum(c) > 2}) for t in grams]

    def _logs(self, table):
        if not table:
            return {}, np.zeros((0, len(self.langs)), np.float32)
        c = np.array(list(table.values()), dtype=np.float64) + 0.1
        logs = np.log(c) - np.log(c.sum(0))
        return {k: i for i, k in enumerate(table)}, (logs - logs.mean(1, keepdims=True)).astype(np.float32)

    def word(self, word: str) -> np.ndarray:
        """Evidence of one lower-case word for each language."""
        index, logs = self.words
        return logs[index[word]] if word in index else self.unseen([word])[0]

    def unseen(self, words: list[str]) -> np.ndarray:
        """Evidence of words outside the model, by row: the mean of the longest n-grams that are in it."""
        out, found = np.zeros((len(words), len(self.langs)), np.float32), [([], [], []) for _ in self.grams]
        for row, word in enumerate(words):
            whole = f"<{word}>"
            for n in range(min(self.max_n, len(whole)), 0, -1):
                index = self.grams[n][0]
                got = [i for at in range(len(whole) + 1 - n) if (i := index.get(whole[at : at + n])) is not None]
                if got:
                    rows, sizes, all = found[n]
                    rows.append(row)
                    sizes.append(len(got))
                    all += got
                    break
        for (_, logs), (rows, sizes, all) in zip(self.grams, found):
            if rows:
                out[rows] = np.add.reduceat(logs[all], np.cumsum(sizes) - sizes) / np.array(sizes, np.float32)[:, None]
        return out


class Evidence:
    """Evidence of words by row, the last column 1 if the word has a letter; a worker keeps the model's words and up to CACHE others."""

    def __init__(self, model: Model):
        self.model, (index, logs) = model, model.words
        self.index, self.known = dict(index), len(index)
        self.rows = np.concatenate([self._lettered(list(index), logs), np.zeros((1024, len(model.langs) + 1), np.float32)])

    @staticmethod
    def _lettered(words: list[str], logs: np.ndarray) -> np.ndarray:
        return np.column_stack([logs, np.array([w.isalpha() or any(map(str.isalpha, w)) for w in words], np.float32)])

    def of(self, words: Counter) -> np.ndarray:
        """Rows of the words, in their order."""
        at = list(map(self.index.get, words, repeat(-1)))
        if -1 in at:
            if len(self.index) > self.known + CACHE:
                self.index = dict(self.model.words[0])
            new, first = [w for w in words if w not in self.index], len(self.index)
            if first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(new), len(self.rows) // 4), self.rows.shape[1]), np.float32)])
            self.rows[first : first + len(new)] = self._lettered(new, self.model.unseen(new))
            self.index.update(zip(new, range(first, first + len(new))))
            at = list(map(self.index.__getitem__, words))
        return self.rows[at]


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """The model of the labelled rows of docs (text, lang), from about ``sample`` documents of each language chosen by a hash.

    Words are counted by language in Spark; the sample bounds what reaches the driver. Rows without text or lang teach
    nothing; a null doc_id is hashed as any other; of an empty table nothing is learned.
    """
    rows = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("share"))
    rows = rows.join(checked_broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    return Model([tuple(r) for r in words.groupBy("lang", "word").count().collect()])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs, from its whole text alone; score is the language's posterior.

    A text is read word by word and only the counts of its distinct words are held, however long it is. A null text, or one without letters, is ``und`` with score 0, and so is every text if nothing was learned. Ties go to
    the first language by code point. Rows that repeat a doc_id are predicted each; an empty table gives an empty result.
    """
    def rows(batch, preds, scores):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return _predicted(docs.select("doc_id", "text"), model, rows, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose language is found with at least this score; ``und`` goes."""

    def rows(batch, preds, scores):
        return batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(preds, scores)], pa.bool_()))

    return _predicted(docs, model, rows, docs.schema)


def _predicted(docs: DataFrame, model: Model, rows, schema) -> DataFrame:
    """docs through rows(batch, predicted languages, scores), in the tasks that scan them."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        worker_cache("language", dict)  # nothing is kept here, but what other operators kept goes
        m: Model = shared.value
        k = len(m.langs)
        # The worker has the same model in its next task, and so what was found of words.
        if m.evidence is None:
            m.evidence = Evidence(m)
        for batch in batches:
            preds, scores = [], []
            for cell in batch.column("text"):
                text = cell.as_py()
                counts = word_counts(text) if text and k else {}
                total = np.fromiter(counts.values(), np.float64, len(counts)) @ m.evidence.of(counts) if counts else np.zeros(k + 1)
                if not k or not total[k]:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                x = total[:k] / total[k] * SHARPNESS
                p = np.exp(x - x.max())
                best = int(p.argmax())
                preds.append(m.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield rows(batch, preds, scores)

    return docs.mapInArrow(predict, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identified(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
