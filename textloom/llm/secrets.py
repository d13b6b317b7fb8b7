"""Secrets by sliding-window Shannon entropy: windows over candidate strings, one alphabet at a time, with allow-listed shapes left out."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import small_batches

#: The base patterns of the contract, fixed values: letters of the names in either case, ASCII only.
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

#: Characters of a candidate, and how many it has at least.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Alphabets from the narrowest to the widest: name, runs of it, characters of a window, bits a character from which a window
#: counts. Random windows have about 3.4 (hex), 4.0 (letters and digits) and 4.0 bits; words and identifiers mostly less.
ALPHABETS = (
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 20, 2.9),
    ("alnum", re.compile(r"[A-Za-z0-9]+"), 20, 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 24, 3.9),
)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, *(f"entropy_{name}" for name, *_ in ALPHABETS))

#: What is never a secret, however mixed: identifiers by their format, samples, and what stands before a digest, a commit,
#: inline data or in an address.
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
SAMPLE = re.compile(r"(?i)example|sample|placeholder|changeme|dummy|xxxx|0000000|1234567|abcdefg")
BEFORE = re.compile(r"(?i)(?:sha-?[0-9]{1,3}|md5|integrity|digest|checksum|etag|commit|blob|tree|parent|revision|base64)[\"']?[\x20:=,_-]*[\"']?$|[a-z][a-z0-9+.]*://[^\x20\x09-\x0D]*$")
_WORDS = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
#: Fixed point of the entropy sums, so that counts going up and down leave no rounding behind.
_ONE = 1 << 40


def window_bits(text: str, width: int) -> Iterator[int]:
    """Shannon entropy, in bits times ``width`` times _ONE, of each window of ``width`` characters; of a shorter text none.

    H * width = width * log2(width) - sum(c * log2(c)): a step changes two counts, so it costs the same for any width.
    """
    if len(text) < width:
        return
    term = [0] + [round(c * math.log2(c) * _ONE) for c in range(1, width + 1)]
    counts, total = dict.fromkeys(text, 0), 0
    for i, c in enumerate(text):
        if i >= width:
            old = counts[text[i - width]]
            counts[text[i - width]] = old - 1
            total += term[old - 1] - term[old]
        n = counts[c]
        counts[c] = n + 1
        total += term[n + 1] - term[n]
        if i >= width - 1:
            yield term[width] - total


def hot_parts(text: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows that reach ``bits`` a character; what is left at an end of the text counts if no window fits in it."""
    least, out = math.floor(bits * width * _ONE), []
    for i, h in enumerate(window_bits(text, width)):
        if h >= least:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + width)
            else:
                out.append((i, i + width))
    if out and out[0][0] < width:
        out[0] = (0, out[0][1])
    if out and len(text) - out[-1][1] < width:
        out[-1] = (out[-1][0], len(text))
    return out


def allowed(text: str, start: int, end: int, whole: int) -> bool:
    """Is the string at start:end, of the candidate that starts at ``whole``, of an allow-listed kind? Samples, digests and
    addresses; characters that follow one another in the alphabet; no mixture of letters and digits; names made of words."""
    s = text[start:end]
    letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
    if letters < 2 or not digits or SAMPLE.search(s) or any(BEFORE.search(text, max(0, at - 200), at) for at in {start, whole}):
        return True
    if 2 * sum(abs(ord(a) - ord(b)) == 1 for a, b in zip(s, s[1:])) > len(s):
        return True
    return 3 * sum(len(m[0]) for m in _WORDS.finditer(s)) > 2 * len(s)


def entropy_spans(text: str, alphabets=ALPHABETS) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the windows find: each alphabet over its own runs of a candidate, the narrowest first; a wider
    one adds what overlaps nothing found before."""
    out = []
    for m in CANDIDATE.finditer(text):
        if UUID.fullmatch(m[0]):
            continue
        got: list[tuple[int, int, int]] = []
        for k, (_, runs, width, bits) in enumerate(alphabets):
            for run in runs.finditer(text, *m.span()):
                for a, b in hot_parts(run[0], width, bits):
                    a, b = a + run.start(), b + run.start()
                    if not allowed(text, a, b, m.start()) and all(b <= x or y <= a for _, x, y in got):
                        got.append((len(BASE_KINDS) + k, a, b))
        out += got
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the contract's base spans. A run of [0-9a-f] or of [A-Z0-9] after AKIA is taken whole and judged by
    its length, which is the same as the longest match from its first character."""
    out = [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(2, *m.span()) for m in HEX.finditer(text)]


def secret_spans(text: str | None) -> tuple[list, list]:
    """Base spans of a text, and these with the spans found by entropy; both by start, then kind. A string may be of several kinds."""
    if not text:
        return [], []
    order = lambda s: (s[1], s[0], s[2])
    base = base_spans(text)
    return sorted(base, key=order), sorted(base + entropy_spans(text), key=order)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end), in code points, end exclusive, by start and kind.

    Whole texts are read, and nothing is shuffled. A null or empty text has no spans. A very long text is one row of one task;
    of a candidate only its counts are held. Rows that repeat a doc_id, or have none, are read each; an empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def read(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for batch in batches:
            both = [secret_spans(cell.as_py()) for cell in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([named(x[i]) for x in both], kind) for i in (0, 1)]], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind: int, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id long, base {spans}, spans {spans}")


def masked(docs: DataFrame) -> DataFrame:
    """docs, row by row, with every secret of text replaced by <secret>; overlapping spans are one secret.

    Null texts stay null, empty ones empty; very long texts, repeated ids and an empty table as in found; other columns stay.
    """
    small_batches(docs.sparkSession)

    def mask(text):
        out, at = [], 0
        for _, start, end in secret_spans(text)[1]:
            if start >= at:
                out += [text[at:start], "<secret>"]
            at = max(at, end)
        return "".join([*out, text[at:]]) if text else text

    def replaced(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([mask(cell.as_py()) for cell in batch.column(i)], batch.schema.field(i).type))

    return docs.mapInArrow(replaced, docs.schema)


def listed(spans):
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def n_spans(kind: int):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the query from those of ``found``. n_entropy counts the spans that the windows found; a string that a base
    pattern finds too is listed under both kinds."""
    entropy = F.size(F.filter("spans", lambda s: s["kind"] >= len(BASE_KINDS))).cast("long")
    return rows.select(
        "doc_id", *[n_spans(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)], F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), entropy.alias("n_entropy")
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(found(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
