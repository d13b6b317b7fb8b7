"""Column functions on text, for batches and streams alike: English, French and Arabic cleaning, tokens and counts."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

Letter = r"\p{L}\p{N}_"


def _sub(c: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(c, pattern, by)


def collapsed(c: Column) -> Column:
    """Runs of white space become one blank; single blanks, which are most of them, are not written anew."""
    return F.trim(_sub(c, r"\s(?:(?<! )|(?=\s))\s*"))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c where f names c several times: within higher-order functions Spark would work c out for each of them."""
    return F.transform(F.array(c), f)[0]


# Predicates


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*L.PLACEHOLDERS)


def is_valid(c: Column) -> Column:
    """Something is left besides ? ! . and blanks, and it is no placeholder."""
    return c.isNotNull() & ~is_placeholder(c) & (F.length(_sub(c, r"[?!.\s]", "")) > 0)


# English


def standardized(c: Column) -> Column:
    return F.replace(_sub(F.lower(c), r"\\n|\n|\r"), F.lit("\u2019"), F.lit("'"))


def without_html(c: Column) -> Column:
    """Tags become blanks, the entities of plain text are decoded; hearts (<3) stay."""
    c = _sub(c, r"<(?!/?3)[^<>]+>")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return collapsed(c)


def without_emojis(c: Column) -> Column:
    """Emojis and control characters go in one pass; plain characters are seen to be neither before any range is looked at."""
    return _sub(c, rf"[[^\x20-\x7E\xA0-\x{{20FF}}]&&[{L.EMOJIS}{L.CONTROLS}]]", "")


def emoticon_pattern() -> str:
    """The first look-ahead holds what emoticons begin with, so that most characters are passed over at once."""
    return rf"(?i)(?=[:;=8>\-^<\\dtuxo])(?<![{Letter}])(?:{'|'.join(L.EMOTICONS)})(?![{Letter}])|{L.SHRUG}"


def without_emoticons(c: Column) -> Column:
    return collapsed(_sub(c, emoticon_pattern()))


def expanded(c: Column) -> Column:
    """Contractions written out: one pattern finds them all, of those that begin at one place the longest, and what stands
    between them is put together again with their long forms."""
    keys = sorted(L.CONTRACTIONS, key=lambda k: (-len(k), k))
    plain = "|".join(k for k in keys if "'" not in k)
    maybe = lambda t: reduce(or_, (F.contains(F.lower(t), F.lit(x)) for x in ["'", *(k for k in keys if "'" not in k)]))
    # A text, then a word, without an apostrophe or one of the few that have none is passed over.
    pattern = F.lit(rf"(?i)\b(?=\w++'|{plain})(?:{'|'.join(map(re.escape, keys))})\b")
    forms = F.create_map(*[F.lit(v) for k in keys for v in (k, f" {L.CONTRACTIONS[k]} ")])
    pieces = lambda t: F.zip_with(F.split(t, pattern, -1), F.regexp_extract_all(t, pattern, F.lit(0)), lambda rest, found: F.concat(rest, F.coalesce(forms[F.lower(found)], F.lit(""))))
    return collapsed(_once(c, lambda t: F.when(maybe(t), F.array_join(pieces(t), "")).otherwise(t)))


def urls_replaced(c: Column) -> Column:
    c = _sub(c, r"https?://(?:[a-zA-Z0-9$-_@.&+!*(),]|%[0-9a-fA-F][0-9a-fA-F])+", " url ")
    bare = lambda t: _sub(t, r"\b(?:www\.\S+\.\S+|\w++\.\w{2,4}/\S*)", " url ")
    return collapsed(_once(c, lambda t: F.when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("www.")), bare(t)).otherwise(t)))


def mentions_replaced(c: Column, by: str = "people") -> Column:
    return _sub(c, rf"@[{Letter}]+", f" {by} ")


def without_hashtags(c: Column) -> Column:
    return collapsed(_sub(c, rf"#[{Letter}]+"))


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(rf"(#[{Letter}]+)"), F.lit(1))


def spaced(c: Column) -> Column:
    return collapsed(_sub(_sub(c, r"\.(?!\.)", ". "), r",(?!\s)", ", "))


def residual(c: Column) -> Column:
    c = _sub(F.replace(c, F.lit("..."), F.lit("<ELLIPSIS>")), rf"[^{Letter}\s!?\-<>']", "")
    return collapsed(_sub(F.replace(c, F.lit("<ELLIPSIS>"), F.lit(" ... ")), r"[^\x00-\x7F]", ""))


def clean_english(c: Column) -> Column:
    """The whole English chain, in the order that results depend on."""
    for step in (standardized, without_html, without_emojis, without_emoticons, expanded, urls_replaced, mentions_replaced, without_hashtags, spaced, residual):
        c = step(c)
    return c


def words(c: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))


def without(tokens: Column, stopwords) -> Column:
    return F.filter(tokens, lambda w: ~w.isin(*stopwords))


def english_tokens(c: Column) -> Column:
    kept = set(L.ENGLISH_KEPT)
    return without(words(c), sorted((set(L.ENGLISH_STOPWORDS) | set(L.ENGLISH_NOISE)) - kept))


# French


def clean_french(c: Column) -> Column:
    c = _sub(F.lower(c), r"\r?\n")
    c = _sub(_sub(_sub(c, L.EMOJIS, ""), r"https?://\S+|www\.\S+", " URL "), rf"@[{Letter}]+", " PEOPLE ")
    c = _sub(_sub(c, rf"#[{Letter}]+", ""), rf"[^{Letter}\s!?\-']", "")
    return collapsed(c)


def french_tokens(c: Column) -> Column:
    return without(words(c), sorted(set(L.FRENCH_STOPWORDS) - set(L.FRENCH_KEPT)))


# Arabic


def structured_arabic(c: Column) -> Column:
    """Markup, links, addresses, numbers of phones and money, dates and times become tokens; phones before dates."""
    steps = (
        (r"<[^>]+>", " "), (r"(?i)http\S+|www\S+|https\S+", " URLTOKEN "), (r"\b[\w.-]+@[\w.-]+\.\w+\b", " EMAILTOKEN "), (r"\+?\d[\d\-\s]{7,}\d", " PHONETOKEN "),
        (r"(\d+(?:[.,]\d+)?)\s*(دولار|ريال|درهم|دينار|جنيه|€|\$|£|ليرة)", " MONEYTOKEN "), (r"\b\d{1,2}[/\-._]\d{1,2}[/\-._]\d{2,4}\b", " DATETOKEN "), (r"\b\d{1,2}\s*(?::|h|H|س|ساعة)\s*\d{0,2}\b", " TIMETOKEN "),
        (r"([!؟?.،,؛;:])\1+", "$1"),
    )
    for pattern, by in steps:
        c = _sub(c, pattern, by)
    return collapsed(c)


def normal_arabic(c: Column) -> Column:
    """Letters of one shape: runs of three or more cut to two, alef, ya and ta marbuta unified, marks and all else dropped."""
    c = _sub(c, r"([\x{0600}-\x{06FF}])\1{2,}", "$1$1")
    c = F.translate(c, "إأآىة", "اااي" + "ه")
    c = _sub(c, r"[\x{0617}-\x{061A}\x{064B}-\x{0652}\x{0670}ـ]", "")
    return collapsed(_sub(_sub(c, r"[،؟؛…]+"), r"[^\x{0600}-\x{06FF}\s]"))


def clean_arabic(c: Column) -> Column:
    return normal_arabic(structured_arabic(c))


_LETTERS = r"[\x{0600}-\x{06FF}]"


def plain_arabic(word: str) -> str:
    """A word of a list in the shape that ``normal_arabic`` gives words of texts."""
    word = word.translate(str.maketrans("إأآىة", "اااي" + "ه"))
    return " ".join(re.sub("[\u0617-\u061A\u064B-\u0652\u0670ـ]", "", word).split())


def _bound(value: Column, f) -> Column:
    """f of a value, which it may name many times: the value is worked out once."""
    return F.transform(F.array(value), f)[0]


def canonical_words(words: Column) -> Column:
    """Words of a normal text without clitics: the article joined to "for" stands alone; one clitic goes before an article, and
    "and" or "so" before a word of discourse; then the article goes, if three letters stay and the word can do without it.

    Each step is a pass over the words, as a step written into the next one would be worked out wherever that names it; the
    first letters, which are cheap to see, decide before a pattern is tried.
    """
    bases = sorted({plain_arabic(w) for w in L.ARABIC_DISCOURSE})
    starts = lambda t, *heads: reduce(or_, (t.startswith(h) for h in heads))

    def joined(t):
        return F.when(t.startswith("لل") & t.rlike(f"^لل{_LETTERS}{{2,}}$"), F.concat(F.lit("ال"), F.substr(t, F.lit(3)))).otherwise(t)

    def clitic(t):
        rest = F.substr(t, F.lit(2))
        before_article = starts(t, *[f"{c}ال" for c in "وفبكل"]) & t.rlike(f"^[وفبكل]ال{_LETTERS}{{2,}}$")
        return F.when(before_article | (starts(t, "و", "ف") & rest.isin(*bases) & t.rlike(f"^[وف]{_LETTERS}{{3,}}$")), rest).otherwise(t)

    def article(t):
        return F.when(t.startswith("ال") & (F.length(t) >= 5) & ~t.isin(*L.ARABIC_WITH_ARTICLE), F.substr(t, F.lit(3))).otherwise(t)

    return F.transform(F.transform(F.transform(words, joined), clitic), article)


def canonical_arabic(token: Column) -> Column:
    """The same of one token."""
    return canonical_words(F.array(token))[0]


def canonical_word(word: str) -> str:
    """The same of a word of a list."""
    t, bases = plain_arabic(word), {plain_arabic(w) for w in L.ARABIC_DISCOURSE}
    if re.fullmatch("لل[\u0600-\u06FF]{2,}", t):
        t = "ال" + t[2:]
    if re.fullmatch("[وفبكل]ال[\u0600-\u06FF]{2,}", t) or (re.fullmatch("[وف][\u0600-\u06FF]{3,}", t) and t[1:] in bases):
        t = t[1:]
    return t[2:] if t.startswith("ال") and len(t) >= 5 and t not in L.ARABIC_WITH_ARTICLE else t


def arabic_stopwords(keep_negations: bool = True) -> list[str]:
    """Stopwords in the shape of tokens, in order; negations turn a meaning around and are left out of them."""
    words = {canonical_word(w) for w in (*L.ARABIC_GENERAL, *L.ARABIC_CONSULTATION, *L.ARABIC_LABEL_WORDS, *L.ARABIC_DATA_WORDS)}
    return sorted(words - ({plain_arabic(w) for w in L.ARABIC_NEGATIONS} if keep_negations else set()))


def arabic_words(clean: Column) -> Column:
    """Words of a text that ``clean_arabic`` gave, as they stand there."""
    return F.regexp_extract_all(clean, F.lit("([ء-ي]+)"), F.lit(1))


def content_arabic(words: Column) -> Column:
    """Canonical words of two letters or more that are no stopwords."""
    stop = arabic_stopwords()
    return F.filter(words, lambda t: (F.length(t) >= 2) & ~t.isin(*stop))


def arabic_tokens(c: Column) -> Column:
    return content_arabic(canonical_words(arabic_words(clean_arabic(c))))


def arabic_phrase(c: Column) -> Column:
    """The canonical words of a phrase, stopwords too, as phrases are compared."""
    return F.array_join(canonical_words(arabic_words(clean_arabic(c))), " ")


def arabic_ngrams(tokens: Column, n: int, phrases=L.ARABIC_PHRASES) -> Column:
    """n-grams of tokens without the phrases that are no content and those of which all words but one are stopwords. What a gram
    is judged by are its tokens' canonical forms, made once a token."""
    stop = arabic_stopwords()
    known = sorted({" ".join(canonical_word(w) for w in plain_arabic(p).split()) for p in phrases})

    def kept(again):
        if n < 2:
            return F.transform(again, lambda g: ~g.isin(*known))
        hits = lambda s: reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [F.slice(s, F.lit(1 + k), F.greatest(F.size(s) - (n - 1), F.lit(0))) for k in range(n)])
        stops = _bound(F.transform(again, lambda w: w.isin(*stop).cast("int")), hits)
        return F.zip_with(ngrams(again, n), stops, lambda g, h: ~g.isin(*known) & (h < n - 1))

    marked = F.zip_with(ngrams(tokens, n), _bound(canonical_words(tokens), kept), lambda g, k: F.struct(g.alias("g"), k.alias("k")))
    return F.transform(F.filter(marked, lambda x: x["k"]), lambda x: x["g"])


def lemma(token: Column, rules=L.ENGLISH_LEMMAS, irregular=L.ENGLISH_IRREGULAR, least: int = 3) -> Column:
    """A lower-case word's lemma: an irregular form by name, else by the longest suffix rule that leaves ``least`` letters."""
    out = F.when(token.isin(*irregular), F.create_map(*[F.lit(v) for pair in irregular.items() for v in pair])[token])
    for suffix, by in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        out = out.when(token.endswith(suffix) & (F.length(token) >= len(suffix) + least), F.concat(F.substr(token, F.lit(1), F.length(token) - len(suffix)), F.lit(by)))
    return out.otherwise(token)


def french_lemma(token: Column) -> Column:
    return lemma(token, L.FRENCH_LEMMAS, L.FRENCH_IRREGULAR)


def emoticons_found(c: Column) -> Column:
    """All matches of each pattern, one pattern after the other: what several patterns match is there several times. Only a text
    that one pattern of all finds something in is read by each of them."""
    one = lambda p: F.regexp_extract_all(c, F.lit(rf"(?i)(?<![{Letter}])(?:{p})(?![{Letter}])"), F.lit(0))
    found = F.concat(*[one(p) for p in L.EMOTICONS], F.regexp_extract_all(c, F.lit(L.SHRUG), F.lit(0)))
    return F.when(c.rlike(emoticon_pattern()), found).when(c.isNotNull(), F.array().cast("array<string>"))


def french_emoticons(c: Column) -> Column:
    """How many emoticons of the French patterns, each pattern by itself, letter case aside."""
    return sum((F.regexp_count(c, F.lit(f"(?i){p}")) for p in L.FRENCH_EMOTICONS[1:]), F.regexp_count(c, F.lit(f"(?i){L.FRENCH_EMOTICONS[0]}")))


def file_name(label: str) -> str:
    """A label as a file name, without the signs that file systems do not take."""
    return re.sub(r'[\\/*?"<>|]+', "_", label).strip()


def clean_label(c: Column) -> Column:
    c = _sub(_sub(F.trim(c), r"\s*-\s*", " - "), r"\s+")
    return F.trim(_sub(c, r"^الحالات\s+النفسي[هة]\s+العصبي[هة]\s*-\s*", ""), F.lit(" -"))


def umbrella(label: Column) -> Column:
    n = normal_arabic(clean_label(label))
    out = None
    for name, pattern in L.UMBRELLAS:
        out = F.when(n.rlike(pattern), name) if out is None else out.when(n.rlike(pattern), name)
    return out.otherwise(L.OTHER_UMBRELLA)


def point_of_view(c: Column) -> Column:
    n = normal_arabic(c)
    doctor, patient = n.rlike(L.DOCTOR_WORDS), n.rlike(L.PATIENT_WORDS)
    return F.when(patient & doctor, "mixed_pov").when(patient, "patient_pov").when(doctor, "doctor_pov").otherwise("unclear_pov")


def stemmed_arabic(token: Column) -> Column:
    """The first prefix, then the first suffix, that leave three letters are dropped."""
    t, out = token, None
    for p in L.ARABIC_PREFIXES:
        hit = t.startswith(p) & (F.length(t) - len(p) >= 3)
        out = F.when(hit, F.substr(t, F.lit(len(p) + 1))) if out is None else out.when(hit, F.substr(t, F.lit(len(p) + 1)))
    t, out = out.otherwise(t), None
    for s in L.ARABIC_SUFFIXES:
        hit = t.endswith(s) & (F.length(t) - len(s) >= 3)
        cut = F.substr(t, F.lit(1), F.length(t) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(t)


# Counts and grams


def occurrences(c: Column, part: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """n-grams joined by ``sep``, by zipping shifted arrays: each token is read n times, whatever the length."""
    g = tokens
    for k in range(1, n):
        rest = F.slice(tokens, F.lit(1 + k), F.greatest(F.size(tokens) - k, F.lit(0)))
        g = F.zip_with(g, rest, lambda a, b: F.when(b.isNotNull(), F.concat_ws(sep, a, b)))
    return F.slice(g, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))


def word_terms(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo to hi words."""
    return F.concat(*[ngrams(tokens, n) for n in range(lo, hi + 1)])


def char_terms(c: Column, lo: int, hi: int) -> Column:
    """All n-grams of lo to hi characters of the text with single blanks; blank ones are left out."""
    chars = F.split(collapsed(c), "")
    return F.filter(F.concat(*[ngrams(chars, n, "") for n in range(lo, hi + 1)]), lambda g: F.trim(g) != "")


def is_content(gram: Column, n: int, stopwords) -> Column:
    """At most n - 2 of an n-gram's words are stopwords (for n = 1, none is)."""
    return F.size(F.filter(F.split(gram, " "), lambda w: w.isin(*stopwords))) < max(1, n - 1)


def content_ngrams(tokens: Column, n: int, stopwords) -> Column:
    return F.filter(ngrams(tokens, n), lambda g: is_content(g, n, stopwords))


def sentence_count(c: Column) -> Column:
    """Sentences that end in . ! or ?, at least one."""
    return F.greatest(F.size(F.filter(F.split(c, r"[.!?]+(?:\s+|\z)"), lambda s: F.trim(s) != "")), F.lit(1))


def contains_arabic(c: Column) -> Column:
    return c.rlike(r"[\x{0600}-\x{06FF}]")


def routed_language(c: Column) -> Column:
    """The pipeline a text goes to: Arabic by its script, else French or English by which stopwords are more frequent."""
    w = words(c)
    votes = [F.size(F.filter(w, lambda x: x.isin(*s))) for s in (L.FRENCH_STOPWORDS, L.ENGLISH_STOPWORDS)]
    return F.when(contains_arabic(c), "arabic").when(votes[0] > votes[1], "french").otherwise("english")


def type_token_ratio(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)


# Language model prompts and replies


def prompt(message: Column, language: str, labels) -> Column:
    head = f"Classify the message below, written in {language}, as one of {list(labels)}.\nMessage: "
    return F.concat(F.lit(head), message, F.lit('\nAnswer only with JSON: {"result": "...", "explanation": "..."}'))


def parsed_reply(raw: Column) -> tuple[Column, Column]:
    """(result, explanation): the reply as JSON, or without its code fence, or its first braces; else __PARSE_ERROR__ and the reply."""
    tries = [raw, F.trim(_sub(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")), F.regexp_extract(raw, r"(?s)(\{.*?\})", 1)]
    read = [F.when(F.trim(t).startswith("{"), F.from_json(t, "result string, explanation string")) for t in tries]
    good = F.coalesce(*[F.when(r["result"].isNotNull(), r) for r in read])
    return F.coalesce(F.trim(good["result"]), F.lit("__PARSE_ERROR__")), F.coalesce(F.trim(good["explanation"]), F.when(good.isNull(), raw), F.lit(""))


def strength(confidence: Column) -> Column:
    return F.when(confidence < 0.55, "Weak").when(confidence < 0.75, "Medium").otherwise("Strong")
