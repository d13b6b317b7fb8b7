"""Personal data by a semi-Markov conditional random field: features of whole spans, and a bounded-entity dynamic program over them."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import materialize, small_batches

KINDS = ("email", "ip", "card", "phone")
#: What the field knows beyond the contract's kinds: keys, tokens and passwords. Its spans have a column of their own.
SECRET = len(KINDS)
OUTSIDE = SECRET + 1
#: The base patterns of the contract, fixed values.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words of the longest entity and of an island that trains, documents of the bounded sample that trains the weights, passes
#: over it, and the posterior from which a span is added to the base spans.
LONGEST = 7
LONGEST_ISLAND = 12
SAMPLE_DOCS = 20_000
EXAMPLES = 500
PASSES = 5
CERTAIN = 0.9
#: A word can be part of an entity only if it holds one of these, or stands up to three words before, or one after, a
#: spelled-out sign.
SIGN = re.compile(r"[0-9@]|(?<![^\x20\x09-\x0D(\[{])(?i:dot)(?![^\x20\x09-\x0D)\]}])|[(\[{](?i:at|dot)[)\]}]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SHORT = re.compile(r"(?=[^@:]*[^\W\d_])[^@:]{1,15}")
_NEXT = re.compile(r"[\x20\x09-\x0D]+(?i:[(\[{]?(?:at|dot)[)\]}]?)(?![^\x20\x09-\x0D])")
#: What labels a secret where the field learns: a name, a sign, a value of 16 or more letters and digits.
SECRET_LABEL = re.compile(r"(?i)\b(?:[a-z_-]*(?:key|token|secret|password|passwd))[\"']?\s*[=:]\s*[\"']?([a-z0-9_+/-]{16,})")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the contract's base spans, in order."""
    out = []
    if "@" in text:
        out += [(0, *m.span()) for m in EMAIL.finditer(text)]
    if SIGN.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def islands(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words that can be part of an entity, as word spans. Entities lie inside them, so the program over
    an island is the program over the whole text."""
    runs: list[list[tuple[int, int]]] = []
    blank = lambda k: text[k] == " " or "\t" <= text[k] <= "\r"

    def put(start: int, end: int, spelled: bool = True) -> None:
        # A short word of letters and digits is no part of an entity unless signs are spelled out next to it.
        if not spelled and _SHORT.fullmatch(text, start, end) and not _NEXT.match(text, end):
            return
        if runs and not WORD.search(text, runs[-1][-1][1], start):
            runs[-1].append((start, end))
        elif not runs or start >= runs[-1][-1][1]:
            runs.append([(start, end)])

    at = 0
    while m := SIGN.search(text, at):
        start = m.start()
        while start > at and not blank(start - 1):
            start -= 1
        end = WORD.match(text, start).end()
        spelled = not ("0" <= m[0] <= "9" or m[0] == "@")
        if spelled:
            before, k = [], start
            for _ in range(3):
                while k > at and blank(k - 1):
                    k -= 1
                if k <= at:
                    break
                last = k
                while k > at and not blank(k - 1):
                    k -= 1
                before.append((k, last))
            for w in reversed(before):
                put(*w)
        put(start, end, spelled)
        at = end
        if spelled and (more := WORD.search(text, end)):
            put(*more.span())
            at = more.end()
    return runs


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A candidate without the punctuation around it."""
    while start < end and not (text[start].isalnum() or text[start] in "+("):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


N_FEATURES = 1024
_HASHED = 128
_OCTETS = re.compile(r"[0-9]{1,3}(?:[^0-9]{1,3}[0-9]{1,3}){3}")
_SPELLED = re.compile(r"(?i)(?<![a-z])(at|dot)(?![a-z])")


def _hashed(kind: str, value: str) -> int:
    return _HASHED + zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % (N_FEATURES - _HASHED)


def features(span: str, words: int, before: tuple[str, str]) -> list[int]:
    """Numbers of the binary features of a whole span: its shape, groups of digits, signs, checks and the words before it. None
    is a base pattern, so the field can find what these miss."""
    d, letters = digits(span), sum(c.isalpha() for c in span)
    groups = re.findall("[0-9]+", span)
    signs = "".join(sorted(set(re.sub(r"[\w\s]", "", span))))
    spelled = {m.lower() for m in _SPELLED.findall(span)}
    tail = re.sub(r"[^a-z]", " ", span.lower()).split()[-1:] or [""]
    octets = len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups) and bool(_OCTETS.fullmatch(span))
    mixed = len(re.findall(r"[a-zA-Z](?=[0-9])|[0-9](?=[a-zA-Z])", span))
    on = [0, 1 + min(words, 9), 11 + min(len(d), 20), 32 + min(letters, 12), 45 + min(len(groups), 8), 54 + min(mixed, 6)]
    tests = (
        "@" in span or "at" in spelled, "dot" in spelled or "." in span, ("@" in span or "at" in spelled) and ("dot" in spelled or "." in span), "at" in spelled, 13 <= len(d) <= 19 and luhn(d) and not letters, 13 <= len(d) <= 19 and not luhn(d),
        span.startswith("+"), span.startswith("00"), span.startswith("("), octets, not letters, letters and d != "", 9 <= len(d) <= 15 and not letters and len(groups) > 2, 2 <= len(tail[0]) <= 3, not span,
        len(span) >= 16 and mixed > 2 and " " not in span, len({c.lower() for c in span if c.isalnum()}) > 8, all(c in "0123456789abcdefABCDEF" for c in span), " " in span.strip(),
    )
    on += [64 + i for i, t in enumerate(tests) if t]
    on += [_hashed("groups", ",".join(str(len(g)) for g in groups[:6])), _hashed("signs", signs), _hashed("length", str(min(len(span) // 4, 12)))]
    on += [_hashed("one", before[0]), _hashed("two", before[1])]
    return on


def _possible(span: str) -> bool:
    """Can several words be one entity? Only with signs spelled out, or as 4 to 20 digits with no letters but a leading word's."""
    if _SPELLED.search(span):
        return True
    return 4 <= len(digits(span)) <= 20 and not any(c.isalpha() for c in span.partition(":")[2] or span)


class Field:
    """Weights of (label, feature) and of (label, next label); label OUTSIDE covers one word at a time."""

    def __init__(self):
        self.w, self.move = np.zeros((OUTSIDE + 1, N_FEATURES)), np.zeros((OUTSIDE + 1, OUTSIDE + 1))

    @staticmethod
    def candidates(text: str, run: list[tuple[int, int]]):
        """(first word, word after the last, span, features) of every segment of up to LONGEST words."""
        near = WORD.findall(text[max(0, run[0][0] - 60) : run[0][0]])[-2:]
        words = [w.lower().strip("\"'.,;()") for w in ["", "", *near, *(text[a:b] for a, b in run)]]
        shift, out = 2 + len(near), []
        for i in range(len(run)):
            for j in range(i + 1, min(len(run), i + LONGEST) + 1):
                span = trimmed(text, run[i][0], run[j - 1][1])
                if j - i > 1 and not _possible(text[span[0] : span[1]]):
                    continue
                out.append((i, j, span, features(text[span[0] : span[1]], j - i, (words[i + shift - 1], words[i + shift - 2]))))
        return out

    def scores(self, segments):
        """Score of each (segment, label); a segment of several words can't be OUTSIDE."""
        s = np.array([self.w[:, f].sum(1) for *_, f in segments])
        s[[j - i > 1 for i, j, *_ in segments], OUTSIDE] = -np.inf
        return s

    def forward(self, n: int, segments, s):
        """Log sums of the segmentations of the first k words by last label, and of the words after k by the label before."""
        a, b = np.full((n + 1, OUTSIDE + 1), -np.inf), np.full((n + 1, OUTSIDE + 1), -np.inf)
        a[0, OUTSIDE] = 0.0
        b[n] = 0.0
        for (i, j, *_), x in sorted(zip(segments, s), key=lambda p: p[0][1]):
            a[j] = np.logaddexp(a[j], np.logaddexp.reduce(a[i][:, None] + self.move, axis=0) + x)
        for (i, j, *_), x in sorted(zip(segments, s), key=lambda p: -p[0][0]):
            b[i] = np.logaddexp(b[i], np.logaddexp.reduce(self.move + (x + b[j])[None, :], axis=1))
        return a, b, np.logaddexp.reduce(a[n])

    def learn(self, examples, passes: int = PASSES, rate: float = 0.5) -> Field:
        """Gradient ascent on the log likelihood of the labelled segmentations, with adaptive steps."""
        gw, gm = np.full_like(self.w, 1e-2), np.full_like(self.move, 1e-2)
        for _ in range(passes):
            for n, segments, gold in examples:
                s = self.scores(segments)
                a, b, z = self.forward(n, segments, s)
                dw, dm = np.zeros_like(self.w), np.zeros_like(self.move)
                for (i, j, _, f), x in zip(segments, s):
                    pair = np.exp(a[i][:, None] + self.move + (x + b[j])[None, :] - z)
                    dm -= pair
                    dw[:, f] -= pair.sum(0)[:, None]
                before = OUTSIDE
                for k, label in gold:
                    dw[label, segments[k][3]] += 1
                    dm[before, label] += 1
                    before = label
                for v, d, g in ((self.w, dw, gw), (self.move, dm, gm)):
                    g += d * d
                    v += rate * d / np.sqrt(g)
        return self

    def entities(self, text: str, run) -> list[tuple[int, int, int, float]]:
        """(kind, start, end, posterior) of the entities of the best segmentation of an island."""
        segments = self.candidates(text, run)
        n, s = len(run), self.scores(segments)
        best, back = np.full((n + 1, OUTSIDE + 1), -np.inf), {}
        best[0, OUTSIDE] = 0.0
        for k in sorted(range(len(segments)), key=lambda k: segments[k][1]):
            i, j = segments[k][:2]
            step = best[i][:, None] + self.move + s[k][None, :]
            at = step.argmax(0)
            for label in range(OUTSIDE + 1):
                if step[at[label], label] > best[j, label]:
                    best[j, label], back[j, label] = step[at[label], label], (k, int(at[label]))
        place, label, path = n, int(best[n].argmax()), []
        while place:
            k, before = back[place, label]
            path.append((k, label))
            place, label = segments[k][0], before
        if all(x == OUTSIDE for _, x in path):
            return []
        a, b, z = self.forward(n, segments, s)
        out = []
        for k, label in reversed(path):
            i, j, span, _ = segments[k]
            if label != OUTSIDE:
                out.append((label, *span, float(np.exp(np.logaddexp.reduce(a[i] + self.move[:, label]) + s[k, label] + b[j, label] - z))))
        return out


def secrets(text: str) -> list[tuple[int, int]]:
    return [m.span(1) for m in SECRET_LABEL.finditer(text) if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])]


def rewritten(text: str, kind: int, start: int, end: int) -> tuple[str, int, int]:
    """An entity of a training piece as the base patterns would miss it, by a hash of it: other separators, signs spelled out."""
    span = text[start:end]
    way = zlib.crc32(span.encode("utf-8", "surrogatepass"))
    sign, stop = ((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("@", " dot "))[way % 4]
    if kind == 0:
        user, _, host = span.partition("@")
        # Names and hosts of other shapes too: without digits, of one word, of two parts.
        user = (user, re.sub("[0-9]", "", user).strip("."), user.replace(".", ""))[way // 4 % 3] or user
        host = (host, re.sub("[0-9]", "", host), ".".join(host.split(".")[-2:]))[way // 12 % 3]
        host = host.rpartition(".")[0] + "." + ("com", "org", "net", host.rpartition(".")[2])[way // 36 % 4]
        new = user + sign + host.replace(".", stop)
    elif kind == 1:
        new = span.replace(".", ("[.]", " . ", "(.)")[way % 3])
    elif kind == 2:
        d = digits(span)
        new = (".", "/", "  ", ". ")[way % 4].join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == 3:
        groups = re.findall("[0-9]+", span)
        new = (("00", "", "(0)", "tel:")[way % 4]) + (".", "-", " ", " / ")[way // 4 % 4].join(groups[way // 16 % 2 :])
    else:
        new = span
    return text[:start] + new + text[end:], start, start + len(new)


def labelled(text: str, spans: dict | None = None) -> list:
    """Training examples of a piece: segmentations by its base spans and secrets (or by ``spans``),
    as far as they are candidates; a piece that one of them cuts is left out."""
    if spans is None:
        spans = {(a, b): SECRET for a, b in secrets(text)} | {(a, b): k for k, a, b in base_spans(text)}
    out = []
    for run in islands(text):
        segments = Field.candidates(text, run)
        inside = {x for x in spans if run[0][0] <= x[0] < run[-1][1]}
        gold, place = [], 0
        while place < len(run):
            k = next((k for k, (i, _, span, _) in enumerate(segments) if i == place and span in inside), None)
            if k is None:
                gold.append((next(k for k, (i, j, *_) in enumerate(segments) if (i, j) == (place, place + 1)), OUTSIDE))
                place += 1
            else:
                gold.append((k, spans[segments[k][2]]))
                inside.discard(segments[k][2])
                place = segments[k][1]
        if not inside:
            out.append((len(run), segments, gold))
    return out


def lessons(text: str) -> list:
    """Examples of a piece as it is, and as its entities would be if the base patterns missed them."""
    out = labelled(text)
    for k, a, b in base_spans(text):
        new, x, y = rewritten(text, k, a, b)
        rest = {(p + len(new) - len(text), q + len(new) - len(text)) if p >= b else (p, q): kind for kind, p, q in base_spans(text) if q <= a or p >= b}
        out += labelled(new, rest | {trimmed(new, x, y): k})
        if k == 0:  # the same words where they spell out no address
            words = re.findall("[A-Za-z]+", text[a:b])
            out += [e for way in (" at the dot ", " dot and at ") for e in labelled(f"{text[:a]}{words[0]}{way}{words[-2]}", {(p, q): kind for (p, q), kind in rest.items() if q <= a})]
    return out


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS, examples: int = EXAMPLES) -> Field:
    """A field trained on islands of about ``sample`` documents chosen by a hash. Labels come from the base patterns and from
    SECRET_LABEL: at most about ``examples`` islands with entities and as many without, again chosen by a hash; the bounds
    are parameters. Longer islands are cut into pieces of LONGEST_ISLAND words. Each entity is learned twice, as it stands
    and rewritten as the patterns would miss it.

    A null text has no islands; of an empty table nothing is learned, and the field then adds nothing.
    """
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))

    def cut(batches):
        for batch in batches:
            found = []
            for cell in batch.column("text"):
                t = cell.as_py()
                for run in islands(t):
                    for i in range(0, len(run), LONGEST_ISLAND):
                        part = run[i : i + LONGEST_ISLAND]
                        before = WORD.findall(t[max(0, part[0][0] - 60) : part[0][0]])[-2:]
                        piece = " ".join([*before, t[part[0][0] : part[-1][1]]])
                        found.append((piece, len(base_spans(piece)) + len(secrets(piece)) > 0))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.bool_())], names=["piece", "entity"])

    found = materialize(rows.select("text").mapInArrow(cut, "piece string, entity boolean").distinct(), "pieces")
    order = F.xxhash64("piece")
    got = [r.piece for kind in (True, False) for r in found.where(F.col("entity") == kind).orderBy(order, "piece").limit(examples).collect()]
    return Field().learn([e for piece in got for e in lessons(piece)])


def private_spans(text: str | None, field: Field, certain: float = CERTAIN) -> tuple[list, list]:
    """Base spans of a text, and all spans: these and the entities of the field's best segmentation whose posterior is at least
    ``certain`` and that overlap no base span; (kind number, start, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    more = [(k, a, b) for run in islands(text) for k, a, b, p in field.entities(text, run) if p >= certain and a < b and all(b <= x or y <= a for _, x, y in base)]
    return base, sorted(base + more)


def found(docs: DataFrame, field: Field, certain: float = CERTAIN) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (kind, start, end), in code points, end exclusive, by kind and start.

    spans are the base spans and what the field adds, kind SECRET included. Whole texts are read; only islands of words with
    a sign reach the dynamic program, since no other word can be part of an entity. Nothing is shuffled.

    A null or empty text has no spans. A very long text is one row of one task, and of it only islands are held. Of ties
    between segmentations the first found stands. Rows that repeat a doc_id, or have none, are read each; an empty table
    gives an empty result. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def read(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        named = lambda spans: [dict(zip(("kind", "start", "end"), s)) for s in spans]
        for batch in batches:
            both = [private_spans(cell.as_py(), shared.value, certain) for cell in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([named(x[i]) for x in both], kind) for i in (0, 1)]], names=["doc_id", "base", "spans"])

    spans = "array<struct<kind: int, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id long, base {spans}, spans {spans}")


def listed(spans):
    kinds = F.array(*map(F.lit, (*KINDS, "secret")))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def n_spans(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def masked(docs: DataFrame, field: Field, certain: float = CERTAIN) -> DataFrame:
    """docs, row by row, with each span of text replaced by its kind in angle brackets; where spans overlap, the first by start.

    Rows without doc_id and rows that repeat one are masked each; null texts stay null; other columns stay as they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def mask(text):
        if not text:
            return text
        out, at = [], 0
        for start, end, kind in sorted((a, b, k) for k, a, b in private_spans(text, shared.value, certain)[1]):
            if start >= at:
                out += [text[at:start], f"<{(*KINDS, 'secret')[kind]}>"]
                at = end
        return "".join([*out, text[at:]])

    def replaced(batches):
        for batch in batches:
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array([mask(cell.as_py()) for cell in batch.column(i)], batch.schema.field(i).type))

    return docs.mapInArrow(replaced, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_spans counts all that is found; spans lists the four kinds of the contract, secrets what else the field found."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = found(docs, fit(docs))
    four, more = F.filter("spans", lambda s: s["kind"] < SECRET), F.filter("spans", lambda s: s["kind"] == SECRET)
    return out.select(
        "doc_id", *[n_spans(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(listed("base"), 256).alias("base_sha256"), listed(four).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), listed(more).alias("secrets"),
    )
