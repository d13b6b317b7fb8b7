"""Removal of repeated 50-byte strings by prefix-free parsing: rolling-hash triggers cut the texts into phrases, and the suffix
array of the dictionary and the order of the parse give the corpus order in which equal strings are neighbours."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import bucket_runs, count_groups, grouped_docs, small_batches, sorted_docs

#: Bytes of a repeated string, and of the window whose rolling hash sets the triggers.
DEPTH = 50
TRIGGER = 24
#: Bytes of a string that can stand before or after its trigger.
SIDE = DEPTH - TRIGGER
#: Text bytes of a group of documents and of a bucket of phrases.
UNIT_BYTES = 8 << 20

_TABLE = np.random.default_rng(4096).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)
_ODD = _TABLE[: (SIDE + DEPTH + 4) // 8]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _joined(h: np.ndarray, m: int, g: np.ndarray) -> np.ndarray:
    """Hashes of strings made of one of h's strings and, m bytes later, one of g's; a hash of n bytes is a polynomial in _BASE."""
    n = max(0, min(len(h), len(g) - m))
    return h[:n] * np.uint64(pow(_BASE, m, 1 << 64)) + g[m : m + n]


def rolling(buffer: np.ndarray) -> np.ndarray:
    """Polynomial hash of every window of TRIGGER bytes in buffer, by doubling (24 = 8 + 16)."""
    one = _TABLE[buffer]
    two = _joined(one, 1, one)
    four = _joined(two, 2, two)
    eight = _joined(four, 4, four)
    return _joined(eight, 8, _joined(eight, 8, eight))


def leftmost_min(h: np.ndarray) -> np.ndarray:
    """For each start of a string, where in it the trigger begins: the least hash of its SIDE + 1 windows, the first of equal ones."""
    at, k, width = np.arange(len(h), dtype=np.int32), 1, SIDE + 1
    while True:
        step = min(k, width - k)
        if step <= 0 or len(h) <= step:
            return at if step <= 0 else at[:0]
        later = h[step:] < h[:-step]
        h = np.where(later, h[step:], h[:-step])
        at = np.where(later, at[step:], at[:-step])
        k += step


class Group:
    """The documents of one group, parsed into phrases.

    Every start of a 50-byte string has a trigger, the window in it with the least rolling hash; the bytes of the string alone
    decide where it stands, so equal strings have equal triggers at equal places. A phrase is a run of starts with one
    trigger: up to SIDE bytes before it (the part that the dictionary holds), the trigger, and up to SIDE bytes after it
    (where the parse reads on). ``at`` is where its trigger begins in the joined texts, ``left`` and ``right`` the bytes
    before and after, ``doc`` the id of its document and ``key`` the mixed hash of the trigger.
    """

    def __init__(self, table: pa.Table):
        self.ids, self.rows = sorted_docs(table)
        self.bytes = [t.encode("utf-8", "surrogatepass") for _, t in self.rows]
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.start = np.cumsum(self.sizes) - self.sizes
        found = [self._phrases(lo, hi) for lo, hi in self._chunks()]
        join = lambda k, kind: np.concatenate([np.zeros(0, kind), *[f[k] for f in found]]).astype(kind)
        self.at, self.left, self.right, self.key = join(0, np.int64), join(1, np.int64), join(2, np.int64), join(3, np.uint64)
        self.doc = self.ids[np.searchsorted(self.start, self.at, side="right") - 1] if len(self.at) else np.zeros(0, np.int64)

    def _chunks(self, size: int = 1 << 17):
        """Ranges of documents of about ``size`` bytes, so that the arrays of one range fit the processor's cache."""
        lo = total = 0
        for i, n in enumerate(self.sizes.tolist()):
            total += n
            if total >= size:
                yield lo, i + 1
                lo, total = i + 1, 0
        if total:
            yield lo, len(self.sizes)

    def _phrases(self, lo: int, hi: int):
        buffer = np.frombuffer(b"".join(self.bytes[lo:hi]), dtype=np.uint8)
        hashes = rolling(buffer)
        trigger = leftmost_min(hashes)
        valid = np.zeros(len(trigger) + 2, dtype=np.int8)  # padded by a start that isn't one on either side
        for x, n in zip((self.start[lo:hi] - self.start[lo]).tolist(), self.sizes[lo:hi].tolist()):
            valid[x + 1 : x + 2 + n - DEPTH] = n >= DEPTH
        cut = trigger[1:] != trigger[:-1]
        inside = valid[1:-1] > 0
        begins, ends = inside & (valid[:-2] == 0), inside & (valid[2:] == 0)
        begins[1:] |= inside[1:] & cut
        ends[:-1] |= inside[:-1] & cut
        first, last = np.flatnonzero(begins), np.flatnonzero(ends)
        at = trigger[first].astype(np.int64)
        return at + self.start[lo], at - first, SIDE - (at - last), _mix(hashes[at])

    def dictionary(self, wanted: np.ndarray):
        """The distinct phrases among ``wanted``: for each, one occurrence and the smallest document; and each occurrence's phrase."""
        joined = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        whole = np.zeros((len(wanted), SIDE + DEPTH), dtype=np.uint8)
        left, right = self.left[wanted], self.right[wanted]
        width = left + TRIGGER + right
        column = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width - (SIDE - left), width)
        whole[np.repeat(np.arange(len(wanted)), width), column] = joined[np.repeat(self.at[wanted] - SIDE, width) + column]
        whole = np.concatenate([whole, np.zeros((len(wanted), 2), np.uint8), left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        words = np.ascontiguousarray(whole).view(np.uint64)
        # By bucket, then by a hash that brings equal phrases together; the bytes say which are equal.
        mixed = _mix((_mix(words) * _ODD).sum(1, dtype=np.uint64))
        order, runs, count = _runs(self.key[wanted] & ~_LOW | mixed & _LOW, equal=words)
        of = np.empty(len(wanted), dtype=np.int64)
        of[order] = np.repeat(np.arange(len(runs)), count)
        low = np.minimum.reduceat(self.doc[wanted][order], runs) if len(runs) else np.zeros(0, np.int64)
        return order[runs], low, of, whole[order[runs]]


def _runs(*columns: np.ndarray, equal: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by columns, the first of each run of equal rows (or of equal rows of ``equal``) in it, and the
    runs' lengths."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0], kind="stable")
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns if equal is None else equal.T:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    runs = np.flatnonzero(new)
    return order, runs, np.diff(np.append(runs, len(order)))


def distinct(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and whether several documents have each."""
    order, runs, _ = _runs(keys)
    if not len(runs):
        return keys, np.zeros(0, bool)
    docs = docs[order]
    return keys[order][runs], np.minimum.reduceat(docs, runs) < np.maximum.reduceat(docs, runs)


def _ranks(first: np.ndarray, columns: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Dense ranks of strings that are extended by one column at a time; of those shorter than that, the rank is -1.

    Extending strings to the left by the byte before them sorts the suffixes of the dictionary (each rank follows from the
    byte and the rank of the suffix one shorter); extending to the right by the byte after sorts how the parse goes on.
    """
    ranks = [first.astype(np.int64)]
    for k in range(columns.shape[1]):
        on = np.flatnonzero(lengths > k)
        out = np.full(len(first), -1, dtype=np.int64)
        _, out[on] = np.unique(columns[on, k].astype(np.int64) << 40 | ranks[-1][on], return_inverse=True)
        ranks.append(out)
    return ranks


def corpus_order(phrases: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each phrase, a bit a string (bit k: the string with k bytes before the trigger): does a smaller document hold it?

    A string is a suffix of a dictionary entry (the bytes before the trigger, and the trigger) and what the parse reads on.
    Corpus order is therefore by the entry's place in the suffix array of the dictionary, then by the place of the parse;
    to depth 50 equal strings are those of equal places, and the bytes themselves are sorted, not their hashes.
    """
    left, right = phrases[:, -2].astype(np.int64), phrases[:, -1].astype(np.int64)
    words = np.ascontiguousarray(phrases[:, SIDE : SIDE + TRIGGER]).view(np.uint64)
    order, runs, count = _runs(*words.T)
    trigger = np.empty(len(phrases), dtype=np.int64)
    trigger[order] = np.repeat(np.arange(len(runs)), count)
    suffixes = _ranks(trigger, phrases[:, SIDE - 1 :: -1][:, :SIDE], left)
    parse = _ranks(trigger, phrases[:, SIDE + TRIGGER : SIDE + DEPTH], right)
    bits = np.zeros(len(phrases), dtype=np.uint32)
    for k in range(SIDE + 1):
        on = np.flatnonzero((left >= k) & (right >= SIDE - k))
        if len(on):
            order, runs, count = _runs(suffixes[k][on] * len(phrases) + parse[SIDE - k][on])
            least = np.repeat(np.minimum.reduceat(low[on][order], runs), count)
            bits[on[order[least < low[on][order]]]] |= np.uint32(1 << k)
    return bits


SENT = "bucket long, g long, keys binary, phrases binary, low binary"
REPLY = "bucket long, g long, bits binary"
WIDTH = SIDE + DEPTH + 4


def sent(g: int, by: np.ndarray, n_buckets: int, keys: np.ndarray | None = None, phrases: np.ndarray | None = None, low: np.ndarray | None = None) -> pa.Table:
    """What a group sends, in order of ``by``, one row for each bucket that gets something."""
    used, at = bucket_runs(by, n_buckets)
    columns = {k: pa.array([v[a:b].tobytes() if v is not None else b"" for a, b in zip(at[:-1], at[1:])], pa.binary()) for k, v in (("keys", keys), ("phrases", phrases), ("low", low))}
    return pa.table({"bucket": pa.array(used, pa.int64()), "g": pa.array([g] * len(used), pa.int64())} | columns)


def replied(by: np.ndarray, replies: pa.Table, step: int, n_buckets: int) -> np.ndarray:
    """A group's replies of one step, in the order of what it sent: a bit a key, or a mask a phrase."""
    used, at = bucket_runs(by, n_buckets)
    place = dict(zip(used.tolist(), zip(at[:-1].tolist(), at[1:].tolist())))
    out = np.zeros(len(by), dtype=bool if step == 1 else np.uint32)
    for s, b, bits in zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "bits"))):
        if s == step:
            lo, hi = place[b]
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo) if step == 1 else np.frombuffer(bits, np.uint32)
    return out


def answer_triggers(table: pa.Table) -> pa.Table:
    """A bit a key: does another group have this trigger?"""
    parts = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(parts)
    order, _, count = _runs(keys)
    shared = np.empty(len(keys), dtype=bool)
    shared[order] = np.repeat(count > 1, count)
    return _answers(table, parts, shared, lambda f: np.packbits(f).tobytes())


def answer_phrases(table: pa.Table) -> pa.Table:
    """A mask a phrase: which of its strings does a smaller document hold?"""
    parts = [np.frombuffer(x, np.int64) for x in table.column("low").to_pylist()]
    phrases = np.frombuffer(b"".join(table.column("phrases").to_pylist()), np.uint8).reshape(-1, WIDTH)
    return _answers(table, parts, corpus_order(phrases, np.concatenate(parts)), np.ndarray.tobytes)


def _answers(table: pa.Table, parts: list, values: np.ndarray, pack) -> pa.Table:
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table({"bucket": table.column("bucket"), "g": table.column("g"), "bits": pa.array([pack(x) for x in np.split(values, ends)], pa.binary())})


def without_repeats(docs: DataFrame, unit_bytes: int = UNIT_BYTES, with_text: bool = False) -> DataFrame:
    """Each document without the bytes that a 50-byte string covers which also starts in a document with a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_text``, kept (binary) and spans (start, end).

    Documents are dealt into groups of about ``unit_bytes`` by a hash of their id, and parsed into phrases in each. In two
    steps a group sends to buckets, by the hash of the trigger, and a bucket answers: 1. its distinct triggers (32 bits each):
    does another group have it? A string whose trigger one document alone has cannot repeat. 2. the dictionary: the bytes of
    its distinct other phrases, with the smallest doc_id of each; the bucket puts all strings with its triggers in corpus
    order and answers which of them a smaller document holds. What is removed is thus decided on bytes. Phrases are distinct
    within a group before they are sent: a passage that a third of all documents share is sent once a group, and a bucket
    holds about as much as a group. A group sends one row to each bucket that gets something, so there are never more rows
    than phrases.

    A null text is empty; a null doc_id counts as larger than all others; rows that repeat a doc_id do not count against
    each other, and ties do not arise, since a string is either equal or not. A very long text is one document of its group,
    which is then larger. An empty table gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    n = count_groups(docs, unit_bytes)
    texts = grouped_docs(docs, n)

    def phrases(group: Group, replies: pa.Table):
        """Which phrases may repeat, and the dictionary of these."""
        known, several = distinct(group.key, group.doc)
        wanted = np.flatnonzero(np.isin(group.key, known[several | replied(known, replies, 1, n)]))
        return wanted, *group.dictionary(wanted)

    def send_triggers(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        group = Group(table)
        keys, _ = distinct(group.key, group.doc)
        return sent(key[0].as_py(), keys, n, keys=(keys & np.uint64(0xFFFFFFFF)).astype(np.uint32))

    def send_phrases(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Group(table)
        wanted, one, low, _, whole = phrases(group, replies)
        return sent(key[0].as_py(), group.key[wanted][one], n, phrases=whole, low=low)

    def assemble(key: tuple[pa.Scalar, ...], table: pa.Table, replies: pa.Table) -> pa.Table:
        group = Group(table)
        wanted, one, low, of, _ = phrases(group, replies)
        bits = replied(group.key[wanted][one], replies, 2, n)[of]
        bits[group.doc[wanted] > low[of]] = (1 << SIDE + 1) - 1
        left, right, at = group.left[wanted], group.right[wanted], group.at[wanted]
        edge = np.zeros(int(group.sizes.sum()) + 1, dtype=np.int32)
        for k in range(SIDE + 1):
            gone = at[(bits >> np.uint32(k) & np.uint32(1) > 0) & (left >= k) & (right >= SIDE - k)] - k
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + DEPTH, -1)
        cover = np.cumsum(edge[:-1]) > 0
        out = []
        for (doc, _), data, first, size in zip(group.rows, group.bytes, group.start.tolist(), group.sizes.tolist()):
            c = cover[first : first + size]
            spans = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept = np.frombuffer(data, np.uint8)[~c].tobytes() if spans else data
            row = (doc, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept, [{"start": a, "end": b} for a, b in spans]) if with_text else row)
        columns = list(zip(*out)) or [()] * (7 if with_text else 5)
        return pa.table([pa.array(c, t) for c, t in zip(columns, TYPES)], names=NAMES[: len(columns)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<struct<start: long, end: long>>" * with_text
    by_group = texts.groupBy("g")
    one = by_group.applyInArrow(send_triggers, SENT).groupBy("bucket").applyInArrow(answer_triggers, REPLY).withColumn("step", F.lit(1))
    two = by_group.cogroup(one.groupBy("g")).applyInArrow(send_phrases, SENT).groupBy("bucket").applyInArrow(answer_phrases, REPLY).withColumn("step", F.lit(2))
    return by_group.cogroup(one.unionByName(two).groupBy("g")).applyInArrow(assemble, schema)


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
TYPES = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"))
