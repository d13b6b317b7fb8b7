"""LM scoring by a hierarchical Pitman-Yor model: context restaurants of the word before share a word restaurant as their
parent, whose base is a hierarchy of spelling restaurants."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import GROUP_BYTES, MOST_PARTITIONS, bucketed, count_groups, materialize, small_batches

#: Gibbs sweeps whose predictive probabilities are averaged, after one that starts from a table a dish; the customers of each
#: dish that get up and sit down again in a sweep; concentration; seed.
SWEEPS = 3
ROUNDS = 4
THETA = 1.0
SEED = 5
#: A probability summed over tasks travels as whole parts.
PARTS = 10**12
#: Symbols of a spelling: 256 bytes and the end of the word. Contexts are the classes of the three bytes before.
SYMBOLS = 257
CLASSES = 32
#: A word's log10 probability travels to its contexts as so many whole parts.
LOG_PARTS = 1000
#: Bits of a word's rank in its bucket of the vocabulary, of a part's number, and of a word's number in the whole vocabulary.
RANK_BITS, PART_BITS, ID_BITS = 24, 20, 40


def _classes() -> np.ndarray:
    """Class of each byte: 0 the start, 1-26 letters, 27 digits, 28 other ASCII, 29 lead bytes, 30 and 31 the rest of a character."""
    c = np.full(256, 28, dtype=np.int64)
    c[97:123], c[48:58] = np.arange(1, 27), 27
    c[0x80:0xA0], c[0xA0:0xC0], c[0xC0:] = 30, 31, 29
    return c


_CLASS = _classes()


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and the end of the text, which is the empty word."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def packed_words(words: list[bytes]) -> bytes:
    """No word holds white space, so a line a word keeps them apart."""
    return b"\n".join(words) + b"\n"


def squeezed(x: np.ndarray | bytes) -> bytes:
    """Numbers for the way: bytes of like weight together, as the upper ones are mostly alike, and compressed."""
    x = np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def spread(blob: bytes, kind) -> np.ndarray:
    """What was squeezed."""
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(blob[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def steps(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences of neighbours, anew at each place of ``first``: what is sorted in runs becomes small."""
    out = np.diff(x, prepend=x[:1] * 0)
    out[first] = x[first]
    return out


def stepped(d: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``steps`` were taken of, in runs of these sizes."""
    total = np.cumsum(d, dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    return total - np.repeat(total[first] - d[first], sizes)


def words_of(blob: bytes) -> list[bytes]:
    return spread(blob, np.uint8).tobytes()[:-1].split(b"\n")


def cells(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of packed words: context * SYMBOLS + symbol; and the number of symbols of each word."""
    raw = np.frombuffer(blob, np.uint8)
    end = raw == 10
    kind = np.where(end, 0, _CLASS[raw])
    past = [np.concatenate([np.zeros(k, np.int64), kind[: max(0, len(kind) - k)]])[: len(kind)] for k in (1, 2, 3)]
    one = past[0]
    two = np.where(one == 0, 0, past[1])
    three = np.where(two == 0, 0, past[2])
    at = np.flatnonzero(end)
    return ((three * CLASSES + two) * CLASSES + one) * SYMBOLS + np.where(end, 256, raw), np.diff(np.concatenate([[-1], at]))


def seat(customers: np.ndarray, new: np.ndarray, discount: float, rng) -> np.ndarray:
    """Where Gibbs sampling starts: tables of each dish after its customers came in, the later ones many at a time.

    ``new`` is the weight of a new table of the dish, (theta + discount * tables of the restaurant) * its parent's probability.
    """
    tables = (customers > 0).astype(np.int64)
    alive = np.flatnonzero(customers > 1)
    i = 1
    while len(alive):
        step = max(1, i // 8)
        a, t = new[alive], tables[alive]
        tables[alive] += rng.binomial(np.minimum(step, customers[alive] - i), a / (a + np.maximum(i - discount * t, 1e-9)))
        i += step
        alive = alive[customers[alive] > i]
    return np.minimum(tables, np.maximum(customers, 0))


class Tables:
    """Seating of the customers of many dishes: the size of each table, table by table in order of the dish."""

    def __init__(self, customers: np.ndarray, new: np.ndarray, discount: float, rng):
        self.all, self.discount, self.rng = customers, discount, rng
        self.busy = np.flatnonzero(customers > 1)  # a lone customer always sits at a table of its own
        self.customers = customers[self.busy].astype(np.int64)
        t = seat(self.customers, new[self.busy], discount, rng)
        self.dish = np.repeat(np.arange(len(t)), t)
        self.size = np.ones(len(self.dish), dtype=np.int64)
        self.size[np.cumsum(t) - t] += self.customers - t

    def _pick(self, weights: np.ndarray, share: np.ndarray, dishes: np.ndarray) -> np.ndarray:
        """For each dish, the table at a share of its weights' sum."""
        total = np.cumsum(weights)
        n = np.bincount(self.dish, minlength=len(self.busy))
        after = np.cumsum(n)
        first, last = (after - n)[dishes], after[dishes] - 1
        before = np.where(first > 0, total[np.maximum(first, 1) - 1], 0)
        return np.clip(np.searchsorted(total, before + share * (total[last] - before), side="right"), first, last)

    def round(self, new: np.ndarray) -> None:
        """One Gibbs step a dish: a random customer leaves its table (which goes if it is empty) and sits down again, at a
        table of the dish by its other customers less the discount, or at a new one by ``new``."""
        if not len(self.busy):
            return
        every = np.arange(len(self.busy))
        self.size[self._pick(self.size, self.rng.random(len(every)), every)] -= 1
        self.dish, self.size = self.dish[self.size > 0], self.size[self.size > 0]
        t = np.bincount(self.dish, minlength=len(every))
        a = new[self.busy]
        opens = self.rng.random(len(every)) * (a + self.customers - 1 - self.discount * t) < a
        joins = every[~opens]
        if len(joins):
            np.add.at(self.size, self._pick(self.size - self.discount, self.rng.random(len(joins)), joins), 1)
        dish = np.concatenate([self.dish, every[opens]])
        order = np.argsort(dish, kind="stable")
        self.dish, self.size = dish[order], np.concatenate([self.size, np.ones(int(opens.sum()), np.int64)])[order]

    def count(self) -> np.ndarray:
        """Tables of each dish."""
        out = (self.all > 0).astype(np.int64)
        out[self.busy] = np.bincount(self.dish, minlength=len(self.busy))
        return out


def gibbs(customers: np.ndarray, new: np.ndarray, discount: float, rng, rounds: int = ROUNDS) -> np.ndarray:
    """Tables of each dish after the customers were seated and ``rounds`` of each dish were seated anew given all others."""
    tables = Tables(customers, new, discount, rng)
    for _ in range(rounds):
        tables.round(new)
    return tables.count()


def seating(context: np.ndarray, customers: np.ndarray, parent: np.ndarray, parts: np.ndarray, seed: int, sweeps: int = SWEEPS) -> tuple[float, np.ndarray]:
    """Discount, and tables of each dish in its context's restaurant, averaged over Gibbs sweeps.

    ``context`` numbers the restaurant of each row, ``parent`` is the dish's probability in the word restaurant, which all
    contexts share. Of a restaurant in ``parts`` parts, dealt by a hash of the dish, one part is here: its tables times the
    parts stand for the restaurant's. A sweep seats customers anew, then counts each restaurant's tables anew.
    """
    discount, rng = discount_of(customers), np.random.default_rng([SEED, seed])
    busy = np.flatnonzero(customers > 1)
    at = context[busy]
    lone = np.bincount(context, weights=customers == 1, minlength=len(parts))
    new = lambda t: (THETA + discount * (parts * (lone + np.bincount(at, weights=t, minlength=len(parts))))[at]) * parent[busy]
    state, mean = Tables(customers[busy], new(np.ones(len(busy))), discount, rng), np.zeros(len(busy))
    for number in range(sweeps + 1):
        for _ in range(ROUNDS):
            state.round(new(state.count()))
        if number:
            mean += state.count()
    tables = (customers > 0).astype(np.float64)
    tables[busy] = mean / sweeps
    return discount, tables


def contexts(context: np.ndarray, customers: np.ndarray, parent: np.ndarray, seed: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Predictive probability of each dish in its context's restaurant, averaged over Gibbs sweeps (see ``seating``)."""
    n = int(context.max(initial=-1)) + 1
    discount, tables = seating(context, customers, parent, np.ones(n), seed, sweeps)
    guests, seated = (np.bincount(context, weights=x, minlength=n)[context] for x in (customers, tables))
    return (customers - discount * tables + (THETA + discount * seated) * parent) / (THETA + guests)


def discount_of(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.05, one / max(1, one + 2 * two)))


class Spelling:
    """Pitman-Yor restaurants over symbols: contexts of three classes share parents of two, these of one, these the root."""

    def __init__(self, cell: np.ndarray, count: np.ndarray, before: Spelling | None, seed: int):
        rng = np.random.default_rng([SEED, seed])
        context, symbol = cell // SYMBOLS, cell % SYMBOLS
        levels, keys, c = [], context, count.astype(np.int64)
        for depth in (3, 2, 1, 0):
            keys = keys % CLASSES**depth
            used, row = np.unique(keys, return_inverse=True)
            full = np.bincount(row * SYMBOLS + symbol, weights=c, minlength=len(used) * SYMBOLS).astype(np.int64)
            at = np.flatnonzero(full)
            keys, symbol, c = used[at // SYMBOLS], at % SYMBOLS, full[at]
            d = discount_of(c)
            if before is None:
                t = (c > 0).astype(np.int64)
            else:
                parent = before.probability(depth - 1, keys, symbol)
                total = np.bincount(at // SYMBOLS, weights=before.tables(depth, keys, symbol), minlength=len(used))
                t = gibbs(c, (THETA + d * total[at // SYMBOLS]) * parent, d, rng)
            levels.append((depth, used, at, c, t, d))
            c = t
        self.matrices, self.used, self.seats = {}, {}, {}
        for depth, used, at, c, t, d in reversed(levels):
            up = np.full((len(used), SYMBOLS), 1 / SYMBOLS) if depth == 0 else self._rows(depth - 1, used % CLASSES ** (depth - 1))
            rows = at // SYMBOLS
            n, m = (np.bincount(rows, weights=x, minlength=len(used))[:, None] for x in (c, t))
            p = (THETA + d * m) * up
            p.reshape(-1)[at] += c - d * t
            self.used[depth], self.matrices[depth], self.seats[depth] = used, (p / (THETA + n)).astype(np.float32), (at, t)

    def _rows(self, depth: int, keys: np.ndarray) -> np.ndarray:
        """Predictive rows of contexts of one depth; an unseen context is its parent's."""
        used = self.used[depth]
        i = np.minimum(np.searchsorted(used, keys), len(used) - 1)
        out, miss = self.matrices[depth][i], used[i] != keys
        if miss.any() and depth:
            out[miss] = self._rows(depth - 1, keys[miss] % CLASSES ** (depth - 1))
        return out

    def probability(self, depth: int, keys: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        if depth < 0:
            return np.full(len(keys), 1 / SYMBOLS)
        keys = keys % CLASSES**depth
        used = self.used[depth]
        i = np.minimum(np.searchsorted(used, keys), len(used) - 1)
        out, miss = self.matrices[depth][i, symbol].astype(np.float64), used[i] != keys
        if miss.any():
            out[miss] = self.probability(depth - 1, keys[miss], symbol[miss])
        return out

    def tables(self, depth: int, keys: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        at, t = self.seats[depth]
        used = self.used[depth]
        i = np.minimum(np.searchsorted(used, keys), len(used) - 1)
        want = np.where(used[i] == keys, i * SYMBOLS + symbol, -1)
        j = np.minimum(np.searchsorted(at, want), len(at) - 1)
        return np.where(at[j] == want, t[j], 1)

    def words(self, blob: bytes) -> np.ndarray:
        """Probability of each packed word under the spelling model, ends included: they sum to 1 over all words."""
        cell, sizes = cells(blob)
        logs = np.log(self.probability(3, cell // SYMBOLS, cell % SYMBOLS))
        return np.exp(np.maximum(np.add.reduceat(logs, np.cumsum(sizes) - sizes), -700)) if len(sizes) else np.zeros(0)


class Sweep:
    """One Gibbs sample of the word restaurant: how many tables each word has, given the spelling model it is drawn with."""

    def __init__(self, number: int, spelling: Spelling | None, tables: int, discount: float, n: int):
        self.number, self.spelling, self.tables, self.discount, self.n = number, spelling, tables, discount, n
        self.unseen = 1.0  # what the spelling model gives to all words outside the vocabulary together
        self.seated = tables  # tables after the sweep, which the predictive probabilities are of

    def base(self, blob: bytes) -> np.ndarray:
        """Probability of each packed word under the spelling model."""
        return self.spelling.words(blob)

    def seats(self, bucket: int, blob: bytes, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of each word of a bucket of the vocabulary, and its probability under the base."""
        if self.spelling is None:
            return (counts > 0).astype(np.int64), np.ones(len(counts))
        base = self.base(blob)
        rng = np.random.default_rng([SEED, self.number, bucket])
        return gibbs(counts, (THETA + self.discount * self.tables) * base, self.discount, rng), base

    def predictive(self, counts, tables, base) -> np.ndarray:
        return (np.maximum(0, counts - self.discount * tables) + (THETA + self.discount * self.seated) * base) / (THETA + self.n)


class Numbers(dict):
    """The number of each word, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


PARSED = "g long, docs array<bigint>, learn binary, sizes binary, words binary, n_buckets long, numbers binary"


def parsed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Documents (doc_id, text, learn) as numbers of words, in groups of about GROUP_BYTES, one row each: they are read and cut into
    words once, where they lie. Words are numbered as they are first seen, so most numbers are small."""

    def parse(batches):
        g, held, size = TaskContext.get().partitionId() << 32, [], 0
        index: Numbers = Numbers()

        def hand_on():
            docs, learn, parts = zip(*held)
            row = (g, docs, np.array(learn, np.bool_).tobytes(), squeezed(np.array([len(p) for p in parts])), squeezed(packed_words(list(index))), n_buckets, squeezed(np.concatenate(parts)))
            kinds = (pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in PARSED.split(", ")])

        for batch in batches:
            for doc, text, learn in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "learn"))):
                held.append((doc, learn, np.fromiter(map(index.__getitem__, tokens(text)), np.uint32)))
                size += len(text or "") + 1
                if size >= GROUP_BYTES:
                    yield hand_on()
                    g, size = g + 1, 0
                    held.clear()
                    index.clear()
        if held:
            yield hand_on()

    return docs.select("doc_id", "text", "learn").mapInArrow(parse, PARSED)


class Parsed:
    """The documents of a group as word numbers; ``words`` are in order of their bucket, a hash of the word."""

    def __init__(self, row: dict):
        self.g, self.docs, self.sizes, names = row["g"], row["docs"], spread(row["sizes"], np.int64), words_of(row["words"])
        bucket = np.fromiter(map(zlib.crc32, names), np.int64, len(names)) % row["n_buckets"]
        order = np.argsort(bucket, kind="stable")
        self.words = [names[i] for i in order.tolist()]
        self.buckets, first = np.unique(bucket[order], return_index=True)
        self.bounds = np.append(first, len(names))
        place = np.empty(len(names), dtype=np.int64)
        place[order] = np.arange(len(names))
        self.word = place[spread(row["numbers"], np.uint32)]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.learn = np.repeat(np.frombuffer(row["learn"], np.bool_), self.sizes)

    def slices(self):
        """(bucket, first, last) of the words of each bucket."""
        return zip(self.buckets.tolist(), self.bounds[:-1].tolist(), self.bounds[1:].tolist())

    def answers(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Training count, log10 probability in the word restaurant, and rank in its bucket of each word."""
        got = {b: x for kind, b, *x in zip(*(replies.column(k).to_pylist() for k in ("kind", "bucket", "a", "b", "c"))) if kind == WORDS}
        counts, p, ranks = (np.concatenate([spread(got[b][i], k) for b in self.buckets.tolist()]) for i, k in enumerate((np.int64, np.float32, np.int32)))
        return counts, p.astype(np.float64), ranks.astype(np.int64)


class Pairs:
    """The distinct pairs after known words, in order of the restaurant's key; all unknown words are one.

    ``key``, ``start``: the restaurants (a context, or its part that the second word's number says) and where their pairs begin;
    ``context``, ``word``, ``id``, ``customers``: of each pair, the first word, the second one, its number in the vocabulary, and
    the training count; ``at``, ``which``: the tokens after known words, and the pair of each.
    """

    def __init__(self, group: Parsed, counts: np.ndarray, ranks: np.ndarray, parts, n_buckets: int):
        # The word before each: at the start of a text its end, as if texts followed each other.
        before = np.roll(group.word, 1)
        self.at = np.flatnonzero(counts[before] > 0)
        n = len(group.words)
        self.ranks, self.bucket = ranks, np.repeat(group.buckets, np.diff(group.bounds))
        # The ranks of all buckets take turns, so likely words have small numbers; 0 is any unknown word.
        ids = np.where(counts > 0, ranks * n_buckets + self.bucket + 1, 0)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[by_id] = np.arange(1, n + 1)
        code, which = np.unique(before[self.at] * (n + 1) + np.where(counts > 0, place, 0)[group.word[self.at]], return_inverse=True)
        context, word = code // (n + 1), np.append(n, by_id)[code % (n + 1)]
        id_ = np.append(ids, 0)[word]
        key = restaurant(self.bucket[context], ranks[context], id_ % parts(counts[context]), n_buckets)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.which = place[which]
        self.context, self.word, self.id = context[order], word[order], id_[order]
        self.key, self.start = np.unique(key[order], return_index=True)
        self.customers = np.bincount(self.which[group.learn[self.at]], minlength=len(order))

    def sizes(self) -> np.ndarray:
        return np.diff(np.append(self.start, len(self.word)))

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the restaurants lie in, and the bounds of each one's."""
        used, first = np.unique(self.key >> RANK_BITS + PART_BITS, return_index=True)
        return used, np.append(first, len(self.key))


def restaurant(bucket: np.ndarray, rank: np.ndarray, part: np.ndarray, n_buckets: int) -> np.ndarray:
    """The key of a part of a context's restaurant: where it is seated, the part, and the context's rank in its own bucket. The
    first part is seated in this bucket, the others in those that follow."""
    return ((bucket + part) % n_buckets << RANK_BITS + PART_BITS) + (part << RANK_BITS) + rank


def asked(groups: DataFrame) -> DataFrame:
    """(bucket, g, words, counts): the distinct words of each group with their training counts, packed by bucket."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                group = Parsed(row)
                counts = np.bincount(group.word[group.learn], minlength=len(group.words))
                rows = [(b, group.g, squeezed(packed_words(group.words[lo:hi])), squeezed(counts[lo:hi])) for b, lo, hi in group.slices()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "g", "words", "counts"])

    return groups.mapInArrow(ask, "bucket long, g long, words binary, counts binary")


VOCABULARY = "bucket long, words binary, counts binary, n long, ones long, twos long, types long"


def merged(words: DataFrame) -> DataFrame:
    """The training words of all groups with their counts, one row a bucket."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        total: Counter = Counter()
        for blob, counts in zip(table.column("words").to_pylist(), table.column("counts").to_pylist()):
            for w, c in zip(words_of(blob), spread(counts, np.int64).tolist()):
                if c:
                    total[w] += c
        words = sorted(total)
        c = np.array([total[w] for w in words], dtype=np.int64)
        row = {"bucket": key[0].as_py(), "words": packed_words(words), "counts": c.tobytes(), "n": int(c.sum()), "ones": int((c == 1).sum()), "twos": int((c == 2).sum()), "types": len(c)}
        return pa.table({k: pa.array([v] if words else [], pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()})

    return materialize(words.groupBy("bucket").applyInArrow(merge, VOCABULARY), "vocabulary")


def vocabulary(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Tokens of docs with their counts, packed by bucket (a hash of the word): each group counts its own rows first."""
    return merged(asked(parsed(docs.withColumn("learn", F.lit(True)), n_buckets)))


def sample(spark: SparkSession, words: DataFrame, sweeps: int = SWEEPS) -> list[Sweep]:
    """Gibbs samples of the model, from a vocabulary: the buckets seat their words in parallel given the spelling model, then the
    spelling restaurants are seated anew from the words' tables.

    What reaches the driver are counts by (context of three classes, symbol): at most 32^3 * 257 numbers whatever the input.
    """
    n, ones, twos = (x or 0 for x in words.agg(F.sum("n"), F.sum("ones"), F.sum("twos")).first())
    discount = min(0.95, max(0.05, ones / max(1, ones + 2 * twos)))
    state, spelling, out = Sweep(0, None, 0, discount, n), None, []
    for number in range(1, sweeps + 3):
        shared = spark.sparkContext.broadcast(state)

        def spelled(batches, shared=shared):
            total = np.zeros(CLASSES**3 * SYMBOLS)
            tables, known = 0, 0.0
            for batch in batches:
                for bucket, blob, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts"))):
                    t, base = shared.value.seats(bucket, blob, np.frombuffer(counts, np.int64))
                    known += float(base.sum())
                    cell, sizes = cells(blob)
                    total += np.bincount(cell, weights=np.repeat(t, sizes), minlength=len(total))
                    tables += int(t.sum())
            at = np.flatnonzero(total)
            n = np.concatenate([total[at], [tables, round(min(known, 1) * PARTS)]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(n)], names=["cell", "n"])

        got = words.select("bucket", "words", "counts").mapInArrow(spelled, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cell, count = got.column("cell").to_numpy(), got.column("n").to_numpy()
        state.seated = tables = int(count[cell == -1].sum())
        state.unseen = max(1 - float(count[cell == -2].sum()) / PARTS, 1e-9)
        if number > 2:
            out.append(state)
        order = np.argsort(cell[cell >= 0])
        if not len(order):
            return []
        spelling = Spelling(cell[cell >= 0][order], count[cell >= 0][order], spelling, number)
        state = Sweep(number, spelling, tables, discount, n)
    return out


WORDS, PAIRS, TOTALS = 0, 1, 2
#: To a group of WORDS: training counts, log10 probabilities, ranks. To a group of PAIRS: customers and tables of each pair and
#: tables of each restaurant, in SWEEPS parts, with the discount. TOTALS: the keys and discounts of parts.
REPLY = "bucket long, g long, kind int, a binary, b binary, c binary, discount double"
SENT = "bucket long, g long, key binary, sizes binary, parts binary, id binary, c binary, p binary"


def scored(docs: DataFrame, learn, sweeps: int = SWEEPS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, spelled_score) of every row of docs, learned from the rows
    where the condition ``learn`` (a column) holds.

    The scores are log10 probabilities of the text's tokens, each given the one before. A word's probability in the word
    restaurant is averaged over Gibbs samples; its base is the word's own spelling. After a word of the training vocabulary
    the probability is that in the restaurant of this context, with the word restaurant as its parent, again averaged over
    Gibbs samples; after an unseen word it is the word restaurant's. score has the events of base_score (add-one over training
    tokens): the training vocabulary and, as one event, any other word, which has the new table's weight times all that the
    spelling model leaves to unseen words. spelled_score tells unseen words apart: each has the new table's weight times the
    probability of its own spelling. Both sum to one over their events.

    Texts are cut into words once, in groups where they lie. A group sends its distinct words to their buckets and gets a count
    and a probability a word back, then its distinct pairs with their training counts to the buckets of their contexts, which
    seat them and send customers less discounts back, and the discounts of the whole restaurant. A context with more than half
    a bucket's share of all tokens is dealt to several buckets by the second word's number; their discounts are added up, so its
    probabilities sum to one too. A frequent word or pair is sent once a group, and nothing is held whole anywhere. A word is known
    by its bucket and its rank there by probability, so pairs are sorted runs of small numbers. Groups stay where they were written.

    A null or blank text is its end alone; a very long one is one document of its group. Without training rows every count is
    0, and score is base_score. Rows that repeat a doc_id are scored each, and learned from each; a null ``learn`` is no; an
    empty table gives an empty result. Ties do not arise. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    n_buckets = count_groups(docs)
    groups = bucketed(parsed(docs, n_buckets), "parsed", "g", min(n_buckets, MOST_PARTITIONS))
    sought = asked(groups)
    words = merged(sought)
    total, types = (x or 0 for x in words.agg(F.sum("n"), F.sum("types")).first())
    samples = sample(spark, words, sweeps)
    event = sum(s.predictive(0, 0, s.unseen) for s in samples) / max(1, len(samples))  # any unseen word
    event_log = math.log10(max(event, 1e-300))
    shared = spark.sparkContext.broadcast(samples)
    base_log = math.log10(total + types + 1)

    def parts(count: np.ndarray) -> np.ndarray:
        """Parts of the restaurant of a word counted so often."""
        return -(-2 * n_buckets * count // max(1, total))

    def reply(bucket: int, to: list[int], kind: int, *blobs: list[bytes], discount: float = 0.0) -> pa.Table:
        n = len(to)
        columns = [pa.array([bucket] * n, pa.int64()), pa.array(to, pa.int64()), pa.array([kind] * n, pa.int32()), *[pa.array(b, pa.binary()) for b in blobs], pa.array([discount] * n, pa.float64())]
        return pa.table(columns, names=["bucket", "g", "kind", "a", "b", "c", "discount"])

    def answer(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
        samples, index, counts, mean, ranks = shared.value, {}, np.zeros(1, np.int64), np.zeros(1), np.zeros(1, np.int32)
        for blob, packed in zip(known.column("words").to_pylist(), known.column("counts").to_pylist()):
            c = np.frombuffer(packed, np.int64)
            index = {w: i for i, w in enumerate(blob[:-1].split(b"\n"))}
            mean = np.append(sum(s.predictive(c, *s.seats(key[0].as_py(), blob, c)) for s in samples) / max(1, len(samples)), 0)
            counts = np.append(c, 0)
            ranks = np.zeros(len(counts), np.int32)
            ranks[np.argsort(-mean[:-1], kind="stable")] = np.arange(len(c))
        found, probabilities, places = [], [], []
        for blob in asked.column("words").to_pylist():
            ws = words_of(blob)
            i = np.fromiter((index.get(w, -1) for w in ws), np.int64, len(ws))
            p, miss = mean[i], np.flatnonzero(i < 0)
            if samples and len(miss):
                spelled = packed_words([ws[k] for k in miss])
                p[miss] = sum(s.predictive(0, 0, s.base(spelled)) for s in samples) / len(samples)
            found.append(squeezed(counts[i]))
            probabilities.append(squeezed(np.log10(np.maximum(p, 1e-300)).astype(np.float32)))
            places.append(squeezed(ranks[i]))
        return reply(key[0].as_py(), asked.column("g").to_pylist(), WORDS, found, probabilities, places)

    def send_pairs(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Parsed(table.to_pylist()[0])
        counts, p, ranks = group.answers(replies)
        pairs = Pairs(group, counts, ranks, parts, n_buckets)
        logs = np.append(np.where(counts > 0, p, event_log), event_log)[pairs.word]
        used, at = pairs.runs()
        start = np.append(pairs.start, len(pairs.word))[at]
        cut = lambda x, at: pa.array([squeezed(x[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())
        short = np.clip(np.rint(logs * LOG_PARTS), -32768, 0).astype(np.int64)
        # A step between two probabilities fits its type as each of them does: it wraps around.
        blobs = [
            cut(steps(pairs.key, at[:-1]), at), cut(pairs.sizes().astype(np.int32), at), cut(parts(counts[pairs.context[pairs.start]]).astype(np.int32), at), cut(steps(pairs.id, pairs.start), start),
            cut(pairs.customers.astype(np.int32), start), cut(steps(short, pairs.start).astype(np.int16), start),
        ]
        return pa.table([pa.array(used, pa.int64()), pa.array([group.g] * len(used), pa.int64()), *blobs], names=[x.split()[0] for x in SENT.split(", ")])

    def seat_pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        every = {c: [spread(x, k) for x in table.column(c).to_pylist()] for c, k in (("key", np.int64), ("sizes", np.int32), ("parts", np.int32), ("id", np.int64), ("c", np.int32), ("p", np.int16))}
        keys = np.concatenate([stepped(x, np.array([len(x)])) for x in every["key"]])
        sizes, n_parts, ids, c, p = (np.concatenate(every[k]) for k in ("sizes", "parts", "id", "c", "p"))
        ids, p = stepped(ids, sizes), stepped(p, sizes).astype(np.int16)
        used, own = np.unique(keys, return_inverse=True)
        of = np.ones(len(used), dtype=np.int64)
        of[own] = n_parts
        pair = np.repeat(own, sizes) << ID_BITS | ids
        order = np.argsort(pair, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]]))
        context, customers = pair[order[first]] >> ID_BITS, np.add.reduceat(c[order].astype(np.int64), first)
        discount, tables = seating(context, customers, 10.0 ** (p[order[first]] / LOG_PARTS), of, key[0].as_py(), sweeps)
        seated = np.rint(tables * sweeps).astype(np.int32)  # tables of all sweeps, a whole number
        there = np.empty(len(pair), dtype=np.int64)
        there[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
        off = np.bincount(context, weights=seated, minlength=len(used)).astype(np.int64)
        split = lambda x, like: [squeezed(y) for y in np.split(x, np.cumsum([len(y) for y in like])[:-1])]
        back = reply(key[0].as_py(), table.column("g").to_pylist(), PAIRS, split(customers[there].astype(np.int32), every["c"]), split(seated[there], every["c"]), split(off[own], every["key"]), discount=discount)
        return pa.concat_tables([back, reply(key[0].as_py(), [-1], TOTALS, [used[of > 1].tobytes()], [(discount * off[of > 1] / sweeps).tobytes()], [None])])

    one = materialize(sought.select("bucket", "g", "words").groupBy("bucket").cogroup(words.select("bucket", "words", "counts").groupBy("bucket")).applyInArrow(answer, REPLY), "answers")
    by_group = groups.groupBy("g")
    sent = by_group.cogroup(one.groupBy("g")).applyInArrow(send_pairs, SENT)
    two = materialize(sent.groupBy("bucket").applyInArrow(seat_pairs, REPLY), "pairs")
    # The parts of frequent contexts: at most 4 for each bucket, whatever the input.
    totals = two.where(F.col("kind") == TOTALS).select("a", "b").collect()
    off_of = {k: x for keys, off in totals for k, x in zip(np.frombuffer(keys, np.int64).tolist(), np.frombuffer(off, np.float64).tolist())}
    split_off = spark.sparkContext.broadcast(off_of)

    def score(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Parsed(table.to_pylist()[0])
        counts, p, ranks = group.answers(replies)
        base, spelled = np.log10(counts + 1.0) - base_log, np.zeros(len(counts))
        if total:
            new = counts == 0
            spelled[new] = p[new] - event_log
            p[new] = event_log
            logs = p[group.word]
            pairs = Pairs(group, counts, ranks, parts, n_buckets)
            got = {b: x for kind, b, *x in zip(*(replies.column(k).to_pylist() for k in ("kind", "bucket", "a", "b", "c", "discount"))) if kind == PAIRS}
            left, off = [np.zeros(0)], [np.zeros(0)]
            for b in pairs.runs()[0].tolist():
                customers, tables, seated, discount = got[b]
                left.append(spread(customers, np.int32) - discount * spread(tables, np.int32) / sweeps)
                off.append(discount * spread(seated, np.int64) / sweeps)
            left, off = np.concatenate(left), np.repeat(np.concatenate(off), pairs.sizes())
            whole = np.full(len(counts), np.nan)
            for u in np.flatnonzero(parts(counts) > 1).tolist():
                keys = restaurant(pairs.bucket[u], ranks[u], np.arange(parts(counts[u])), n_buckets)
                whole[u] = sum(split_off.value.get(k, 0.0) for k in keys.tolist())
            whole = whole[pairs.context]
            off = np.where(np.isnan(whole), off, whole)
            parent = 10.0 ** np.append(p, event_log)[pairs.word]
            q = (left + (THETA + off) * parent) / (THETA + counts[pairs.context])
            logs[pairs.at] = np.log10(np.maximum(q, 1e-300))[pairs.which]
        else:
            logs = base[group.word]
        by_text = lambda x: np.add.reduceat(x, group.first)
        columns = [pa.array(group.docs, pa.int64()), pa.array(group.sizes), pa.array(by_text((counts[group.word] > 0).astype(np.int64))), pa.array(np.full(len(group.first), total, np.int64)), pa.array(by_text(base[group.word])), pa.array(by_text(logs)), pa.array(by_text(logs + spelled[group.word]))]
        return pa.table(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"])

    replies = one.unionByName(two.where(F.col("kind") == PAIRS))
    return by_group.cogroup(replies.groupBy("g")).applyInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, ~held_out())
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score")
