"""Words and pairs of words of whole texts, counted and weighted as numbers where texts are read.

No token leaves a task: a first pass adds up all totals in a table of fixed size, so that only terms that can be among the most
frequent are counted by name; later passes know the terms that are kept and take all others for none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import _typed, most_frequent, within
from .partial import settled

#: Bytes of texts that are cut into words at a time, unless one text has more.
BYTES_AT_ONCE = 2 << 20
#: Sums that totals are added up in, as a power of two, and how many of them make a row.
SUMS, ROW = 22, 512
#: Tasks that add up totals, in all and for each core, at most the larger: each sends a table of all sums.
TASKS, TASKS_A_CORE = 64, 4
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.char.isalpha(np.arange(0x110000, dtype=np.uint32).view("U1"))


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of the runs of letters of texts, as ``functions.text.words`` has them of texts in lower case, but for letters
    that are newer than Java's."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[lo:hi]
    is_letter = letters()[:256] & (np.arange(256) < 128)
    inside = is_letter[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        for n in (2, 3, 4):
            at = lead[size == n]
            code = (data[at] & (0x7F >> n)).astype(np.int32)
            for k in range(1, n):
                code = code << 6 | (data[at + k] & 0x3F)
            at = at[letters()[code]]
            for k in range(n):
                inside[at + k] = True
    first = np.zeros(len(data) + 1, bool)  # bytes that begin a text
    first[offsets - lo] = True
    change = inside[1:] != inside[:-1]
    start, end = np.empty(len(data), bool), np.empty(len(data), bool)
    start[:1], end[-1:] = inside[:1], inside[-1:]
    start[1:], end[:-1] = inside[1:] & (change | first[1:-1]), inside[:-1] & (change | first[1:-1])
    start = np.flatnonzero(start)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(end) + 1 - start)]).astype(np.int32)
    word = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    return np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, offsets - lo))), word


def hashes(word: pa.Array) -> np.ndarray:
    """64 bits of each word's first and last eight bytes and its length."""
    offsets = np.frombuffer(word.buffers()[1], np.int32)[word.offset : word.offset + len(word) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(word.buffers()[2] or b"", np.uint8)[: offsets[-1]], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = np.diff(offsets)
    part = np.uint64(2**64 - 1) >> (64 - 8 * np.minimum(size, 8)).astype(np.uint64)
    head, tail = eight[offsets[:-1]] & part, eight[np.maximum(offsets[:-1], offsets[1:] - 8)] & part
    h = head * ODD[0] ^ (tail + size.astype(np.uint64)) * ODD[1]
    return (h ^ h >> np.uint64(32)) * ODD[2]


def sum_of(word: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Which sum the total of a word belongs to, by its hash, or that of a pair of words."""
    h = word if after is None else (word ^ word >> np.uint64(29)) * ODD[0] + (after ^ after >> np.uint64(32)) * ODD[1]
    return ((h ^ h >> np.uint64(31)) * ODD[2] >> np.uint64(64 - SUMS)).astype(np.int64)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.Array, np.ndarray]]:
    """(first row, row from there, word, where a word and the next are of one text) of a batch's ``text``, some rows at a time."""
    texts = batch.column("text")
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BYTES_AT_ONCE, side="right")) - 1)
        row, word = words(texts.slice(first, last - first))
        yield first, row, word, np.flatnonzero(row[:-1] == row[1:])
        first = last


def summed(texts: DataFrame) -> np.ndarray:
    """2 ** SUMS numbers: each is the sum of the totals of all words and pairs that belong to it, so none of them is above it."""

    def rows(at, sums):
        ends = np.arange(len(sums) + 1, dtype=np.int32) * (8 * ROW)
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.Array.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sums))])], names=["at", "sums"])

    def add(batches):
        total = np.zeros(1 << SUMS, np.int64)
        for batch in batches:
            for _, _, word, pair in pieces(batch):
                h = hashes(word)
                for at in (sum_of(h), sum_of(h[pair], h[pair + 1])):
                    np.add.at(total, at, 1)
        # by place of the byte: high bytes are zeros, which take no room in shuffle files
        for at in np.split(np.arange((1 << SUMS) // ROW), 16):
            yield rows(at, total.reshape(-1, ROW)[at].view(np.uint8).reshape(-1, ROW, 8).transpose(0, 2, 1))

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, planes in zip(batch.column("at").to_pylist(), batch.column("sums")):
                own = np.ascontiguousarray(np.frombuffer(planes.as_buffer(), np.uint8).reshape(8, ROW).T).view(np.int64).ravel()
                total[at] = total[at] + own if at in total else own
        if total:
            yield rows(list(total), np.array(list(total.values())))

    tasks = max(TASKS, TASKS_A_CORE * texts.sparkSession.sparkContext.defaultParallelism)
    own = texts.select("text").coalesce(tasks).mapInArrow(add, "at int, sums binary")
    out = np.zeros(((1 << SUMS) // ROW, ROW), np.int64)
    for at, sums in own.repartition("at").mapInArrow(merge, "at int, sums binary").collect():
        out[at] = np.frombuffer(sums, np.int64)
    return out.ravel()


def named(texts: DataFrame, kept: np.ndarray) -> DataFrame:
    """(term, df, total) of the words and pairs whose sum is kept."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(kept))

    def counted(row, key, n):
        """How many rows have each of n keys, and how often."""
        return np.bincount(np.unique(row.astype(np.int64) * n + key) % n, minlength=n), np.bincount(key, minlength=n)

    def count(batches):
        kept = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for _, row, word, pair in pieces(batch):
                h = hashes(word)
                pair = pair[kept[sum_of(h[pair], h[pair + 1])]]
                coded = word.dictionary_encode()
                code, name, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, len(coded.dictionary)
                single = np.flatnonzero(kept[sum_of(hashes(name))][code])
                if len(single):
                    df, total = counted(row[single], code[single], n)
                    seen = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([name.take(pa.array(seen)), pa.array(df[seen]), pa.array(total[seen])], names=["term", "df", "total"])
                if len(pair):
                    both, key = np.unique(code[pair] * n + code[pair + 1], return_inverse=True)
                    df, total = counted(row[pair], key, len(both))
                    term = pc.binary_join_element_wise(name.take(pa.array(both // n)), name.take(pa.array(both % n)), " ")
                    yield pa.RecordBatch.from_arrays([term, pa.array(df), pa.array(total)], names=["term", "df", "total"])

    return texts.select("text").mapInArrow(count, "term string, df long, total long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def vocabulary(texts: DataFrame, n_docs: DataFrame, least: int, most: float, features: int) -> DataFrame:
    """(term, df, idf) of the most frequent words and pairs of (text, in lower case), as ``models.vocabulary`` has them.

    A term with a total below the floor is not counted by name. This is right if ``features`` terms within the limits reach the
    floor, which is seen afterwards; if they do not, the floor is lowered until they do or all terms are counted.
    """
    sums, rank = summed(texts), features + features // 4 + 1
    floor = max(1, int(np.partition(sums, -rank)[-rank])) if rank <= len(sums) else 1
    while True:
        able = within(settled(named(texts, sums >= floor), "counts"), n_docs, least, most)
        if floor == 1 or able.where(F.col("total") >= floor).count() >= features:
            return most_frequent(able, features)
        floor = max(1, floor // 2)


@dataclass(frozen=True)
class Terms:
    """The terms of a vocabulary: all words that are in one, the term that a word is (else -1), and pairs by the numbers of their
    words, in order, with the terms that they are. A vocabulary is bounded, so its terms go to every task."""

    names: pa.Array
    idf: np.ndarray
    words: pa.Array
    single: np.ndarray
    pairs: np.ndarray
    both: np.ndarray

    def counts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, row from there, term, tf) of the terms of a batch's texts, some rows at a time."""
        for first, row, word, at in pieces(batch):
            coded = word.dictionary_encode()
            known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            term = self.single[known]
            own, at = np.flatnonzero(term >= 0), at[(known[at] >= 0) & (known[at + 1] >= 0)]
            rows, terms = [row[own]], [term[own]]
            if len(self.pairs) and len(at):
                pair = known[at] * len(self.words) + known[at + 1]
                place = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
                found = self.pairs[place] == pair
                rows.append(row[at[found]])
                terms.append(self.both[place[found]])
            key, tf = np.unique(np.concatenate(rows) * len(self.names) + np.concatenate(terms), return_counts=True)
            if len(key):
                yield first, key // len(self.names), key % len(self.names), tf

    def weights(self, batch: pa.RecordBatch, sublinear: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, term, weight) with rows of length 1, some rows at a time."""
        for first, row, term, tf in self.counts(batch):
            v = (np.log(tf) + 1 if sublinear else tf) * self.idf[term]
            norm = np.sqrt(np.bincount(row, weights=v * v))
            yield first + row, term, v / norm[row]


def terms(vocab: DataFrame) -> Terms:
    """The terms of a vocabulary of words and pairs (term, idf)."""
    table = vocab.select("term", "idf").toArrow().combine_chunks()
    names = table.column("term").combine_chunks() if len(table) else pa.array([], pa.string())
    split = [t.split(" ") for t in names.to_pylist()]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for t in split for w in t))}
    single = np.full(len(number) + 1, -1)  # the last is of words that are in no term
    pairs = {}
    for i, t in enumerate(split):
        if len(t) == 1:
            single[number[t[0]]] = i
        else:
            pairs[number[t[0]] * len(number) + number[t[1]]] = i
    keys = np.array(sorted(pairs), np.int64)
    return Terms(names, table.column("idf").to_numpy(), pa.array(list(number), pa.string()), single, keys, np.array([pairs[k] for k in keys.tolist()], np.int64))


def class_sums(texts: DataFrame, known: Terms, sublinear: bool = False) -> DataFrame:
    """(term, label, o): the sums of the weights of (label, text) by class."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def add(batches):
        known = shared.value
        for batch in batches:
            coded = batch.column("label").dictionary_encode(null_encoding="encode")
            label, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            keys, sums = [], []
            for row, term, weight in known.weights(batch, sublinear):
                key, own = np.unique(term * n + label[row], return_inverse=True)
                keys.append(key)
                sums.append(np.bincount(own, weights=weight))
            if keys:
                key, own = np.unique(np.concatenate(keys), return_inverse=True)
                o = np.bincount(own, weights=np.concatenate(sums))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key % n)), known.names.take(pa.array(key // n)), pa.array(o)], names=["label", "term", "o"])

    return texts.select("label", "text").mapInArrow(add, _typed(texts, ["label"], "term string, o double")).groupBy("term", "label").agg(F.sum("o").alias("o"))


def weighted(texts: DataFrame, known: Terms, kept: DataFrame, sublinear: bool = False, also: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """(doc_id, also, term, weight) of (doc_id, also, text): rows of length 1, of which only the terms of ``kept`` are shown; rounded."""
    shown = pc.is_in(known.names, value_set=pa.array([r.term for r in kept.select("term").collect()], pa.string())).to_numpy(zero_copy_only=False)
    shared, keys = texts.sparkSession.sparkContext.broadcast((known, shown)), ("doc_id", *also)

    def weigh(batches):
        known, shown = shared.value
        for batch in batches:
            for row, term, weight in known.weights(batch, sublinear):
                own = np.flatnonzero(shown[term])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(row[own])) for k in keys], known.names.take(pa.array(term[own])), pa.array(np.floor(weight[own] * 10.0**digits + 0.5) / 10.0**digits)], names=[*keys, "term", "weight"])

    return texts.select(*keys, "text").mapInArrow(weigh, _typed(texts, keys, "term string, weight double"))
