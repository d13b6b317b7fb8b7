"""Packing by minimum bin slack: a bitset subset-sum picks the multiset of lengths that fills each sequence best."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right, insort
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import MOST_PARTITIONS, give_back, materialize, small_batches, worker_cache

#: Tokens of a sequence, the id that ends a document, and the pieces among which a sequence is filled.
LENGTH = 4096
END = 2
WINDOW = 1024
#: Distinct chunks whose ids a worker keeps; when there are more, those met once go, and if need be the rarer of the others.
CACHE = 200_000
#: Characters of texts that are encoded at once; a longer text is encoded by itself.
ENCODED = 1 << 21

#: Pieces of one bucket, in which sequences are filled.
BUCKET_PIECES = 32_768

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECE + ", sequence_id long, offset long, sequence_length long"
#: White space to Python's split, not to the tokenizer: a text with any of these is one chunk.
ODD = re.compile("[\x1c-\x1f]")
#: Letters whose lower case may depend on their place or length; texts with any are left as they are.
OTHER = re.compile("[^\x00-\u012f]")
#: How a tokenizer must prepare texts for chunks between white space to be encoded apart; by any other, texts are encoded whole.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def spelled_bytes() -> dict[int, int]:
    """The letter that a byte-level tokenizer writes for each byte: printable ones as they are, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return dict(zip([b for b in range(256) if b not in plain], range(256, 512)))


class Encoder:
    """Token ids of whole texts. The tokenizer never joins across white space, so ids are found once for each distinct chunk.

    Texts of Latin letters are lower-cased first (the tokenizer does it too, and composes nothing there), and a full stop or
    comma that ends a chunk after a letter or number is split off, as the tokenizer does; both only make more chunks alike.
    A text that holds one of the tokenizer's added tokens goes through it whole, and so does every text if the tokenizer
    prepares texts in another way than NORMALIZERS and SPLIT say.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        described = json.loads(self.tokenizer.to_str())
        self.added = [t["content"].lower() for t in described["added_tokens"]]
        self.by_chunk = self._by_chunk(described)
        # One model in memory: ASCII chunks, which the normalizer would leave as they are, go through it without one.
        self.normal, self.none, self.model = self.tokenizer.normalizer, normalizers.Sequence([]), self.tokenizer.model
        self.spelled = spelled_bytes()
        #: Chunk to 3 * slot + (0: as it is, 1: a full stop follows, 2: a comma follows).
        self.index: dict[str, int] = {}
        self.flat, self.ends, self.uses = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self._learn(["", ".", ","])

    @staticmethod
    def _by_chunk(described: dict) -> bool:
        n, p = described.get("normalizer") or {}, described.get("pre_tokenizer") or {}
        parts = p.get("pretokenizers", [])
        return [x["type"] for x in n.get("normalizers", [])] == NORMALIZERS and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"].get("Regex") == SPLIT

    def _whole(self, text: str) -> bool:
        low = text.lower()
        return not self.by_chunk or any(t in low for t in self.added) or bool(ODD.search(text))

    def _learn(self, chunks: list[str]) -> None:
        # Lower-case Latin letters are one word, of which only bytes are to be spelled, so the tokenizer's model takes them.
        letters = [c for c in chunks if c.isalpha() and c.islower() and not OTHER.search(c)] if self.by_chunk else []
        rest = set(chunks).difference(letters) if letters else chunks
        ascii = [c for c in rest if c.isascii() and c.islower()]
        others = [c for c in rest if not (c.isascii() and c.islower())]
        ids = [[t.id for t in self.model.tokenize(c if c.isascii() else c.encode().decode("latin-1").translate(self.spelled))] for c in letters]
        self.tokenizer.normalizer = self.none
        ids += [e.ids for e in self.tokenizer.encode_batch_fast(ascii, add_special_tokens=False)]
        self.tokenizer.normalizer = self.normal
        ids += [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        n = len(self.uses)
        self.index.update(zip(letters + ascii + others, range(3 * n, 3 * (n + len(chunks)), 3)))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(i) for i in ids])])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def _forget(self) -> None:
        self.uses[[self.index[c] // 3 for c in ("", ".", ",")]] += 1 << 40
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.cache // 2:
            keep = np.sort(keep[np.argpartition(-self.uses[keep], self.cache // 2)[: self.cache // 2]])
        to = np.full(len(self.uses), -1)
        to[keep] = 3 * np.arange(len(keep))
        to = to.tolist()
        self.index = {w: to[c // 3] + c % 3 for w, c in self.index.items() if to[c // 3] >= 0}
        n = np.diff(self.ends)[keep]
        ends = np.concatenate([[0], np.cumsum(n)])
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(self.ends[keep] - ends[:-1], n)]
        self.ends, self.uses = ends, self.uses[keep] // 2

    def _slots(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cache slots of each distinct chunk: of the chunk itself, or of what is before its last stop, and of that stop (else -1)."""
        code = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(code < 0)
        if len(missing):
            new = [chunks[i] for i in missing.tolist()]
            cut = {c: 1 + (c[-1] == ",") if len(c) > 1 and c[-1] in ".," and c[-2].lower()[-1].isalnum() else 0 for c in new}
            heads = {c[:-1] if k else c for c, k in cut.items()}.difference(self.index)
            self._learn(sorted(heads))
            self.index.update({c: self.index[c[:-1]] + k for c, k in cut.items() if k})
            code[missing] = np.fromiter(map(self.index.__getitem__, new), np.int64, len(new))
        stops = np.array([-1, self.index["."] // 3, self.index[","] // 3])
        return code // 3, stops[code % 3]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, the end id last."""
        if len(self.uses) > self.cache:
            self._forget()
        whole = {i: t for i, t in enumerate(texts) if self._whole(t)}
        lowered = ["" if i in whole else t if OTHER.search(t) else t.lower() for i, t in enumerate(texts)]
        parts = pc.ascii_split_whitespace(pa.array(lowered, pa.large_string()))
        coded = parts.flatten().dictionary_encode()
        head, stop = self._slots(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        self.uses += np.bincount(head[at], minlength=len(self.uses))
        extra = stop[at] >= 0
        place = np.arange(len(at)) + np.cumsum(extra) - extra
        slots = np.empty(len(at) + int(extra.sum()), dtype=np.int64)
        slots[place] = head[at]
        slots[place[extra] + 1] = stop[at[extra]]
        # The slots' ids one after the other, then cut where each text's last slot ends.
        taken = pa.LargeListArray.from_arrays(pa.array(self.ends), pa.array(self.flat)).take(pa.array(slots))
        ids, upto = taken.flatten().to_numpy(), taken.offsets.to_numpy()[1:] - taken.offsets[0].as_py()
        last = np.concatenate([place + extra, [len(slots)]])  # last slot of each chunk
        chunk_end = np.diff(parts.offsets.to_numpy()).cumsum()
        text_end = np.where(chunk_end > 0, upto[last[np.maximum(chunk_end, 1) - 1]] if len(upto) else 0, 0)
        done, first = [], 0
        for i, to in enumerate(text_end.tolist()):
            got = ids[first:to] if i not in whole else np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, dtype=np.uint32)
            done.append(np.append(got, np.uint32(END)))
            first = to
        return done


def best_fill(lengths: list[int], count, capacity: int) -> list[int]:
    """Lengths (with repeats) whose sum is the largest up to capacity: bitset subset-sum with backtracked counts.

    lengths are distinct and ascending, count(length) says how many there are; all are above 0.
    """
    mask, steps, bits = (1 << capacity + 1) - 1, [], 1
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[at]
        steps.append((length, bits))
        for _ in range(min(count(length), capacity // length)):
            bits = (bits | bits << length) & mask
        if bits >> capacity & 1:
            break
    total, taken = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        while not before >> total & 1:
            taken.append(length)
            total -= length
    return taken


def encoder_of(path: str, cache: int = CACHE) -> Encoder:
    """This worker's encoder, which keeps what it has learned from task to task."""
    return worker_cache(("packing", path, cache), lambda: Encoder(path, cache))


class Pool:
    """Pieces that wait for a sequence, by length."""

    def __init__(self):
        self.items: dict[int, list] = {}
        self.lengths: list[int] = []
        self.size = 0

    def add(self, length: int, item) -> None:
        if length not in self.items:
            insort(self.lengths, length)
            self.items[length] = []
        self.items[length].append(item)
        self.size += 1

    def _take(self, length: int):
        items = self.items[length]
        item = items.pop()
        if not items:
            del self.items[length]
            self.lengths.pop(bisect_right(self.lengths, length) - 1)
        self.size -= 1
        return item

    def fill(self, capacity: int) -> list:
        """Takes the longest piece and the others that fit best with it."""
        first = self.lengths[-1]
        taken = [self._take(first)]
        return taken + [self._take(k) for k in best_fill(self.lengths, lambda k: len(self.items[k]), capacity - first)]


def runs(texts: list[str], most: int = ENCODED):
    """texts in order, in lists of at most ``most`` characters or one text."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, cache: int = CACHE, encoded: int = ENCODED) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, copy): each document's ids, the end id last, cut into full sequences and a
    rest. copy numbers the equal pieces of one batch, so that a document that is repeated very often is not one key."""
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def cut(batches):
        encoder = encoder_of(path, cache)
        for batch in batches:
            out, seen = [], Counter()
            ids = chain.from_iterable(map(encoder.encode, runs([t or "" for t in batch.column("text").to_pylist()], encoded)))
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), ids):
                for start in range(0, len(tokens), length):
                    piece = tokens[start : start + length]
                    row = (doc, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(tokens))
                    out.append((*row, seen[row]))
                    seen[row] += 1
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 6)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE + ", copy long")


def filled(table: pa.Table, bucket: int, length: int, window: int) -> pa.Table:
    """The pieces of a bucket with sequence_id, offset and sequence_length."""
    table = table.sort_by([(c, "ascending") for c in ("ids_crc32", "doc_id", "start", "length", "doc_tokens")])
    sizes = np.asarray(table.column("length"))
    sequence, offset = np.empty(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    full = np.flatnonzero(sizes == length)
    sequence[full] = np.arange(len(full))
    number, pool = len(full), Pool()

    def close(least: int):
        nonlocal number
        while pool.size > least:
            at = 0
            for item in pool.fill(length):
                sequence[item], offset[item] = number, at
                at += int(sizes[item])
            number += 1

    for i in np.flatnonzero(sizes != length).tolist():
        pool.add(int(sizes[i]), i)
        if pool.size >= 2 * window:
            close(window)
    close(0)
    held = np.bincount(sequence, weights=sizes, minlength=number).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
    padded = np.where(held & (held - 1) == 0, held, length)
    columns = [table.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    return pa.table(columns + [pa.array(sequence + (bucket << 32)), pa.array(offset), pa.array(padded[sequence])], names=[x.split()[0] for x in SCHEMA.split(", ")])


def packed(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES, cache: int = CACHE, encoded: int = ENCODED) -> DataFrame:
    """One row a piece: where its tokens stand in their document and in their sequence, and how long the sequence is padded.

    A document's ids (the end id last) are cut into full sequences; what remains, at most ``length`` - 1 ids, is placed by
    minimum bin slack within a window of pieces: the longest piece opens a sequence, and a bitset subset-sum over the
    multiset of the window's lengths fills it as closely as can be. Texts are encoded where they are read; only the pieces'
    short rows (no ids) move, by a hash, to buckets of about ``bucket_pieces``, and a bucket fills its sequences. So padding
    does not grow with the number of files or tasks, only with that of buckets, and the result does not depend on either.
    A sequence is padded to ``length``, but not if its own length is a power of two. Where executors are short of memory,
    ``cache`` (chunks that a worker keeps) and ``encoded`` (characters encoded at once) can be less; the result is the same.

    A null or empty text is the end id alone. A very long text is many full sequences and one rest. Rows that repeat a doc_id
    are packed each. Pieces of equal length and ids are ties, of which any goes first. An empty table gives an empty result.
    Other columns are ignored.
    """
    rows = materialize(pieces(docs, tokenizer, length, cache, encoded), "pieces")
    n = max(1, -(-rows.count() // bucket_pieces))
    names = [x.split()[0] for x in PIECE.split(", ")]
    dealt = rows.select(*names, F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32", "copy"), F.lit(n)).alias("bucket"))

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return filled(table, key[0].as_py(), length, window)

    return dealt.repartition(min(n, MOST_PARTITIONS), "bucket").groupBy("bucket").applyInArrow(fill, SCHEMA)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))
