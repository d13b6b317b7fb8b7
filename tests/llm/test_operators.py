"""Each operator against a brute-force version, an exact round trip or held-out accuracy; then nulls, ties, repeats and empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict
from unittest import mock

import duckdb
import numpy as np
import pytest

from pyspark.sql import functions as F

from textloom.llm import common, exact_dedup, language, lm, mixing, near_dedup, packing, pii, quality, registry, repeats, sharding

from . import brute


@pytest.fixture(scope="module")
def texts(table):
    return {i: r.text for i, r in table.items()}


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    # Whole numbers with nulls are kept differently by the two; both become one kind.
    got, want = got.convert_dtypes(), con.sql(registry.ORACLE_SQL[name]).df().convert_dtypes()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_quality_edges(edge, empty):
    rows = quality.judged(edge).collect()
    assert len(rows) == edge.count() and quality.judged(empty).count() == 0
    text = {r.doc_id: r.text for r in edge.collect()}
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_rules(text[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_boilerplate(spark):
    footer = "Read more  stories on our site today"
    rows = [(i, f"{' '.join(f'w{i}x{k}' for k in range(20))}\n{footer if i % 2 else footer.lower()}", "h") for i in range(60)]
    rows += [(100, footer + "\n" + footer.lower() + "\n" + footer + " three more words", "h"), (101, rows[0][1], "h")]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].n_removed_words == 7 and got[i].kept for i in range(60))
    assert got[100].n_removed_words == 14 and got[101].n_removed_words == 7
    far = [(i, t, f"h{i}") for i, t, _ in rows]
    assert not any(r.n_removed_words for r in quality.judged(spark.createDataFrame(far, "doc_id long, text string, source string")).collect())


def test_quality_depleted(spark):
    lines = [" ".join(f"c{k}x{j}" for j in range(11)) for k in range(3)]
    rows = [(i, "\n".join([*lines, " ".join(f"w{i}x{k}" for k in range(4 if i < 30 else 60))]), "h") for i in range(60)]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(r.n_removed_lines == 3 and r.n_removed_words == 33 and not r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(30))


def check_shards(rows, text):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        data = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key") and r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_groups_follow_bytes_alone(spark):
    sized = lambda n: spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"repeat('x', {n})").alias("text"))
    assert [common.count_groups(sized(n), 800) for n in (0, 99, 100, 250, 800, 5000, 6401, 64_000)] == [1, 1, 1, 2, 8, 8, 9, 80]


def test_shards(spark, sf, texts):
    rows = sharding.op2(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    check_shards(rows, texts)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert order != sorted(order) and rows == sharding.op2(spark, sf).collect()


def test_shards_in_many_buckets(edge, empty, tmp_path):
    rows = sharding.sharded(edge, 4, bucket_bytes=2000).collect()
    assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in edge.collect()) and len({r.bucket for r in rows}) > 3
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.sharded(empty).count() == 0
    sharding.write_shards(edge, str(tmp_path / "out"), shards=4)
    assert edge.sparkSession.read.parquet(str(tmp_path / "out")).count() == edge.count()


def test_shards_of_odd_columns_and_other_partitions(spark):
    rows = [(i % 50 if i < 90 else None, None if i % 7 == 0 else f"text {i % 60}", {"a": i}, i, i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>, `a.b` int, Shard int")
    got = [sharding.sharded(d, 4, bucket_rows=5) for d in (docs.repartition(1), docs.repartition(7))]
    assert got[0].columns == ["doc_id", "text", "m", "a.b", "shard", "bucket", "slot"]
    one, two = (Counter((r.doc_id, r.text, r.shard, r.bucket, r.slot) for r in g.collect()) for g in got)
    assert one == two and sum(one.values()) == 100


def test_shards_of_many_equal_rows(spark):
    """A third of all rows are one document: its copies spread over buckets, and partitions change nothing."""
    rows = [(1, "same text")] * 6000 + [(None, None)] * 100 + [(i, f"text {i}") for i in range(2, 12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sharding.sharded(d, 4, bucket_rows=256).collect() for d in (docs.repartition(5), docs.repartition(11))]
    assert Counter(map(tuple, got[0])) == Counter(map(tuple, got[1])) and len(got[0]) == len(rows)
    sizes, slots = Counter((r.shard, r.bucket) for r in got[0]), defaultdict(list)
    for r in got[0]:
        slots[r.shard].append(r.slot)
    assert max(sizes.values()) < 5 * 256 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len({r.shard for r in got[0] if r.doc_id == 1}) == 1


def test_fisher_yates(spark):
    drawn = [tuple(r.p) for r in spark.range(4000).select(sharding.fisher_yates(F.lit(3), F.xxhash64("id")).alias("p")).collect()]
    assert len(Counter(drawn)) == 6 and min(Counter(drawn).values()) > 500
    assert [r.p for r in spark.createDataFrame([(1,), (9,)], "n int").select(sharding.fisher_yates(F.col("n"), F.lit(1)).alias("p")).collect()][0] == [0]


def check_mix(rows, sizes, source):
    total, taken = Counter(), Counter()
    for r in rows:
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert r.size == sizes[r.doc_id] and 0 <= r.taken <= 2 * r.size
    target = brute.fair(total)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
    for s in total:
        smallest = sorted(r.size for r in rows if source[r.doc_id] == s)
        assert taken[s] <= target[s] + 1e-6 and target[s] - taken[s] <= max(0.02 * target[s], smallest[-1])


def test_mix(spark, sf, table):
    rows = mixing.op3(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(table)
    check_mix(rows, {i: len(brute.words(r.text)) for i, r in table.items()}, {i: r.source for i, r in table.items()})
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op3(spark, sf).collect()))


def test_mix_edges(edge, empty):
    rows = mixing.mixture(edge, block_words=50).collect()
    assert len(rows) == edge.count() and all(len(r.shards) == r.copies for r in rows)
    size = Counter()
    for r in edge.collect():
        size[r.source] += len(brute.words(r.text))
    target = brute.fair(size)
    assert all(r.target == pytest.approx(target[r.source]) for r in rows) and mixing.mixture(empty).count() == 0
    out = mixing.mixed(edge, block_words=50)
    assert set(edge.columns) <= set(out.columns) and out.count() == sum(r.copies for r in rows)


def test_mix_of_repeated_ids(spark, tmp_path):
    rows = [(i % 10, " ".join(["w"] * (5 + i)), "ab"[i % 2]) for i in range(40)] + [(3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {(r.doc_id, r.size): r.copies for r in mixing.mixture(docs, block_words=60).collect()}
    got = Counter((r.doc_id, len(brute.words(r.text))) for r in mixing.mixed_rows(docs, block_words=60).collect())
    assert all(got[k] == n for k, n in plan.items()) and set(got) <= set(plan)
    mixing.write_mixture(docs, str(tmp_path / "mix"), block_words=60)
    out = spark.read.parquet(str(tmp_path / "mix"))
    assert out.count() == sum(plan.values()) and {r.shard for r in out.select("shard").distinct().collect()} <= set(range(8))


def test_splitting_tree():
    quotas = np.array([1000, 7, 0, 300])
    leaves = [mixing._split(quotas, 6, k, 3) for k in range(6)]
    assert (sum(leaves) == quotas).all() and max(map(sum, leaves)) - min(map(sum, leaves)) <= 2


def test_near(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.op4(spark, sf).collect()}
    assert got == brute.near(texts) and len({c for _, c in got.values()}) < len(got)


def test_near_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[(i * 2) % 120] = f"x{i}"
        rows.append((i, " ".join(w[: 100 + i % 20])))
    rows += [(200 + i, " ".join(base[: 60 + 3 * i])) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near(dict(rows))


def test_near_edges(edge, empty):
    rows = near_dedup.near_groups(edge).collect()
    want = brute.near({r.doc_id: r.text for r in edge.collect() if r.doc_id is not None})
    assert len(rows) == edge.count() and near_dedup.near_groups(empty).count() == 0
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)
    kept = near_dedup.keep_near(edge)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.doc_id is None or r.doc_id == r.component_id)


def test_near_of_repeated_ids_and_stars(spark):
    """A hub with many copies, a chain beyond it, and an id whose texts belong to two groups and so join them."""
    base = [f"w{i}" for i in range(100)]
    edit = lambda w, at, by: " ".join([*w[:at], by, *w[at + 1 :]])
    rows = [(i, edit(base, i % 97, f"x{i}")) for i in range(40)]
    other = [f"v{i}" for i in range(100)]
    rows += [(100 + i, edit(other, 10 * i + 3, f"y{i}")) for i in range(6)]
    rows += [(5, " ".join(other)), (5, " ".join(base)), (5, " ".join(base))]
    got = [(r.doc_id, r.component_id) for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows) and set(c for _, c in got) == {0}


def test_components(spark):
    r = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in r.integers(0, 400, (260, 2))] + [(500 + i, 501 + i) for i in range(60)] + [(700, 701 + i) for i in range(90)]
    want = brute.components({x for p in links for x in p if p[0] != p[1]}, links)
    got = {x.id: x.component for x in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_joining_many_groups(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    rows = spark.createDataFrame([(i % 3 if i < 50 else i, i) for i in range(100)], "k long, v long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert common.join_groups(rows, groups, "k", "n").count() == 100


def test_lm(spark, sf, texts):
    rows = lm.op5(spark, sf).collect()
    want = brute.add_one(texts)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.held_out == (brute.crc(r.doc_id) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-4) and np.isfinite(r.score) and r.score < 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in lm.op5(spark, sf).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in rows)


def test_lm_sums_to_one(spark, documents):
    words = lm.vocabulary(documents, 3)
    for s in lm.sample(spark, words, 2):
        total = s.predictive(0, 0, s.unseen)
        for r in words.collect():
            c = np.frombuffer(r.counts, np.int64)
            total += s.predictive(c, *s.seats(r.bucket, r.words, c)).sum()
        assert total == pytest.approx(1, abs=0.01)


def test_contexts_sum_to_one():
    """A context's probabilities over all words: those seen in it, and the rest of the word restaurant."""
    r = np.random.default_rng(2)
    parent = r.dirichlet(np.ones(50))
    context, customers, word = np.repeat([0, 1], 50), r.poisson(0.7, 100), np.tile(np.arange(50), 2)
    p = lm.contexts(context, customers, parent[word], 1, 3)
    assert p[:50].sum() == pytest.approx(1) and p[50:].sum() == pytest.approx(1)
    assert (p[customers > 2] > parent[word][customers > 2]).mean() > 0.9


def test_reseating_keeps_customers():
    r = np.random.default_rng(3)
    customers = r.integers(0, 200, 300)
    tables = lm.Tables(customers, np.full(300, 0.5), 0.6, r)
    for _ in range(20):
        tables.round(np.full(300, 0.5))
        assert (np.bincount(tables.dish, weights=tables.size, minlength=len(tables.busy)) == tables.customers).all() and (tables.size > 0).all()
    count = tables.count()
    assert (count[customers > 0] >= 1).all() and (count <= np.maximum(customers, 0)).all() and (count[customers == 0] == 0).all()


def test_reseating_draws_the_chinese_restaurant():
    """Three customers of one dish: the sampler meets one, two and three tables as often as the process does, given the dish."""
    a, d = 0.8, 0.3
    tables, seen = lm.Tables(np.full(4000, 3), np.full(4000, a), d, np.random.default_rng(4)), np.zeros(4)
    for i in range(60):
        tables.round(np.full(4000, a))
        if i >= 20:
            seen += np.bincount(tables.count(), minlength=4)
    weight = np.array([a * (1 - d) * (2 - d), 3 * a * a * (1 - d), a**3])
    assert seen[1:] / seen.sum() == pytest.approx(weight / weight.sum(), abs=0.01)


def test_lm_knows_copies(spark):
    """A text that the training rows hold scores above base and above its words in another order."""
    r = np.random.default_rng(5)
    text = [" ".join(f"w{k}" for k in r.integers(0, 3000, 80)) for _ in range(200)]
    mixed = [" ".join(sorted(t.split())) for t in text[:20]]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(text)] + [(1000 + i, t, False) for i, t in enumerate(text[:20])] + [(2000 + i, t, False) for i, t in enumerate(mixed)], "doc_id long, text string, train boolean")
    got = {x.doc_id: x for x in lm.scored(docs, F.col("train")).collect()}
    copies, others = [got[1000 + i] for i in range(20)], [got[2000 + i] for i in range(20)]
    assert all(x.n_known == x.n_tokens for x in copies + others)
    assert sum(x.score for x in copies) > sum(x.base_score for x in copies) and sum(x.score for x in copies) > sum(x.score for x in others)


def test_lm_edges(edge, empty):
    assert lm.scored(edge, F.lit(True)).count() == edge.count() and lm.scored(empty, F.lit(True)).count() == 0
    none = lm.scored(edge.where("doc_id < 6"), F.lit(None).cast("boolean")).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(r.base_score, abs=1e-3) for r in none)
    rows = lm.scored(edge, F.col("doc_id") > 100).collect()
    assert all(r.spelled_score <= r.score + 1e-9 for r in rows) and any(r.spelled_score < r.score for r in rows)


def check_packed(rows, texts, copies=None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for i, t in texts.items()}
    for i, x in ids.items():
        n = copies[i] if copies else 1
        assert sum(r.length for r in pieces[i]) == n * len(x)
        for r in pieces[i]:
            assert r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        starts = sorted((r.start, r.length) for r in pieces[i])
        assert starts == sorted([(k, min(4096, len(x) - k)) for k in range(0, len(x), 4096)] * n)
    held = {i: sum(n for _, n in s) for i, s in sequences.items()}
    assert all(r.sequence_length == (held[r.sequence_id] if held[r.sequence_id].bit_count() == 1 else 4096) for r in rows)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return sum(map(len, ids.values())) / (4096 * len(sequences))


def test_pack(spark, sf, texts):
    assert check_packed(packing.op6(spark, sf).collect(), texts) > 0.9


def test_pack_does_not_depend_on_splits(spark, documents):
    one, many = (Counter(map(tuple, packing.packed(documents.repartition(n), bucket_pieces=50).collect())) for n in (1, 40))
    assert one == many


def test_pack_does_not_depend_on_memory(spark, documents):
    little, much = (Counter(map(tuple, packing.packed(documents, **k).collect())) for k in ({"cache": 200, "encoded": 5000}, {}))
    assert little == much


def test_pack_special_tokens(spark):
    rows = [(1, "one <|endoftext|> two"), (2, "<|STARTOFTEXT|> A"), (3, "<|endoftext|><|endoftext|>"), (4, "< |endoftext| >"), (5, "x\x1cy Don't STOP, caf\u00e9")]
    check_packed(packing.packed(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))


def test_pack_with_another_tokenizer(spark, documents):
    """A tokenizer that prepares texts otherwise encodes them whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, docs = Tokenizer.from_file(path), documents.where("doc_id < 20")
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert {r.doc_id: r.doc_tokens for r in packing.packed(docs, path).collect()} == want


def test_pack_edges(edge, empty):
    rows = packing.packed(edge.where("doc_id is not null and doc_id <> 15")).collect()
    check_packed(rows, {r.doc_id: r.text for r in edge.collect() if r.doc_id not in (None, 15)})
    assert packing.packed(edge).where("start = 0").count() == edge.count() and packing.packed(empty).count() == 0


def test_best_fill():
    rng = np.random.default_rng(0)
    for _ in range(50):
        pool = Counter(rng.integers(1, 40, 8).tolist())
        sums = {0}
        for x in pool.elements():
            sums |= {s + x for s in sums if s + x <= 60}
        got = packing.best_fill(sorted(pool), pool.__getitem__, 60)
        assert sum(got) == max(sums) and not Counter(got) - pool


def test_language(spark, sf, table):
    rows = language.op7(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(table) and all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    for r in rows:
        text = table[r.doc_id].text
        if not any(map(str.isalpha, text or "")):
            assert r.lang_pred == "und"
    held = [r for r in rows if r.held_out and table[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == table[r.doc_id].lang for r in held) > 0.9 * len(held) > 10


def test_language_backs_off():
    words = {"en": "nation station motion caption section thinking the with", "de": "zeitung meinung wohnung rechnung sch\u00f6n nicht schule und"}
    m = language.Model([(x, w, 9) for x, ws in words.items() for w in ws.split()])
    for lang, known, unseen in (("en", "nation", "potion"), ("de", "zeitung", "achtung")):
        assert m.langs[m.word(known).argmax()] == lang == m.langs[m.word(unseen).argmax()] and unseen not in m.words[0]


def test_language_score_means_the_same_at_every_length():
    m = language.Model([(x, w, 9) for x, ws in {"en": "the with nation", "de": "der mit zeitung"}.items() for w in ws.split()])
    docs = [("the nation der", 1), ("the nation der " * 50, 1)]
    got = []
    for text, _ in docs:
        words = Counter(language.WORD.findall(text))
        total = sum(n * m.word(w) for w, n in words.items()) / sum(words.values()) * language.SHARPNESS
        got.append(float(np.exp(total - total.max()).max() / np.exp(total - total.max()).sum()))
    assert got[0] == pytest.approx(got[1], rel=1e-5)


def test_language_keeps_evidence():
    texts = ["The nation\u2019s \u0153uvre, 2nd na\xefve_caf\xe9 \xbd \xb2x", "\u4e2d\u6587 und stra\xdfe \u0130x", "a\x85b\xa0c\x1cd", "", "wort " * 300_000 + "Nationen zq9zq"]
    for text in texts:
        assert list(language.word_counts(text).items()) == list(Counter(language.WORD.findall(text.lower())).items())
    m = language.Model([(x, w, 9) for x, ws in {"en": "the with nation", "de": "der mit zeitung"}.items() for w in ws.split()])
    kept = language.Evidence(m)
    for text in texts * 2:
        words = language.word_counts(text)
        got = kept.of(words)
        assert got.shape == (len(words), 3)
        for row, w in zip(got, words):
            assert np.allclose(row[:2], m.word(w)) and row[2] == any(map(str.isalpha, w))
    # Words of the model stay when the others go, and none of either is looked for twice.
    asked, unseen = [], m.unseen
    m.unseen = lambda words: asked.extend(words) or unseen(words)
    for text in texts:
        kept.of(language.word_counts(text))
    assert not asked
    with mock.patch.object(language, "CACHE", 2):
        kept.of(Counter(["newer", "nation"]))
    assert asked == ["newer"] and set(kept.index) == {*m.words[0], "newer"}


def test_language_learns_rare_languages(spark):
    rows = [(i, "the quick brown fox and the lazy dog", "en") for i in range(3000)] + [(5000 + i, "kuu paistaa j\u00e4rven yli hiljaa", "fi") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(docs, sample=50)
    assert m.langs == ["en", "fi"] and {r.lang_pred for r in language.identified(docs.where("lang = 'fi'"), m).collect()} == {"fi"}


def test_language_edges(edge, empty):
    m = language.fit(edge)
    got = language.identified(edge, m).collect()
    assert len(got) == edge.count() and {r.doc_id for r in got if r.lang_pred == "und"} == {1, 2, 3, 12}
    assert language.identified(empty, m).count() == 0 and {r.lang_pred for r in language.identified(edge, language.fit(empty)).collect()} == {"und"}
    kept = language.keep_identified(edge, m)
    assert kept.columns == edge.columns and not {1, 2, 3, 12} & {r.doc_id for r in kept.collect()}


def test_exact_edges(edge, empty):
    rows = exact_dedup.exact_groups(edge).collect()
    text = {r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}
    want = brute.exact(text)
    assert len(rows) == edge.count() and exact_dedup.exact_groups(empty).count() == 0
    assert all(r.keep_id == want[r.doc_id] and (not r.kept or r.keep_id == r.doc_id) for r in rows if r.doc_id is not None)
    assert Counter(r.keep_id for r in rows if r.kept) == Counter({r.keep_id for r in rows})
    kept = exact_dedup.keep_exact(edge)
    assert kept.columns == edge.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)


def test_exact_query_edges(spark, edge, tmp_path):
    extra = [(15, "same same", "en", "a", 1), (None, None, "en", "a", 2), (-1, "same same", "en", "a", 9), *((200, f"hot text {i % 3}", "en", "a", 9) for i in range(30))]
    docs = edge.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda t: hashlib.sha256(brute.re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    got = exact_dedup.op8(spark, str(tmp_path)).collect()
    rows = docs.collect()
    assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((r.doc_id, digest(r.text)) for r in rows)
    size = Counter(digest(r.text) for r in rows)
    assert all(r.group_size == size[r.text_sha256] for r in got)
    groups = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter(map(tuple, groups))
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(size.keys())
    kept = exact_dedup.keep_exact(docs).collect()
    assert Counter(digest(r.text) for r in kept) == Counter(size.keys())


def test_exact_keeps_other_texts_of_an_id(spark):
    rows = [(0, "a b"), (1, "a b"), (1, "other"), (None, "a b"), (None, "alone")]
    kept = exact_dedup.keep_exact(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(0, "a b"), (1, "other"), (None, "alone")])


def check_private(rows, texts):
    for r in rows:
        want = brute.base_spans(texts[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r.spans.split(",") if r.spans else [])


def test_private(spark, sf, texts):
    rows = pii.op9(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and sum(r.n_email for r in rows)
    check_private(rows, texts)


def test_private_edges(edge, empty):
    field = pii.fit(edge)
    text = {r.doc_id: r.text for r in edge.collect()}
    rows = pii.found(edge, field).collect()
    assert len(rows) == edge.count() and pii.found(empty, pii.fit(empty)).count() == 0
    for r in rows:
        want = brute.base_spans(text[r.doc_id])
        assert [f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base] == want
    every = pii.masked(edge, field)
    assert every.columns == edge.columns and every.count() == edge.count() and every.where("doc_id is null").count() == 1
    masked = {r.doc_id: r.text for r in every.collect()}
    assert masked[1] is None and "<email>" in masked[11] and "z.org" not in masked[11] and "<ip>" in masked[11]


def test_field_finds_what_the_patterns_miss(spark):
    """Trained on a table's own spans, the field finds planted entities that no base pattern matches, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field, r = pii.fit(docs), np.random.default_rng(5)
    words = "the of river stone quiet morning walks under bright lamps".split()
    some = lambda: " ".join(r.choice(words) for _ in range(6))
    n = lambda a, b: str(r.integers(a, b))

    def entity(kind):
        if kind == 0:
            user, host, end = r.choice(words) + n(1, 99), r.choice(words), r.choice(["org", "com", "net"])
            return f"{user}(at){host}(dot){end}" if r.random() < 0.5 else f"{user} at {host} dot {end}"
        if kind == 1:
            return r.choice(["[.]", "(.)"]).join(n(0, 256) for _ in range(4))
        if kind == 2:
            d = "".join(n(0, 10) for _ in range(15))
            d = next(d + str(c) for c in range(10) if pii.luhn(d + str(c)))
            return r.choice([".", "/"]).join(d[i : i + 4] for i in range(0, 16, 4))
        return r.choice(["00", ""]) + r.choice([".", "-"]).join([n(1, 99), n(100, 999), n(100, 999), n(1000, 9999)])

    plain = (lambda: f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}", lambda: n(1, 10**6), lambda: f"{n(1, 9)}.{n(0, 20)}.{n(0, 9)}", lambda: f"{n(0, 24)}:{n(10, 60)}")
    hit = wrong = 0
    for i in range(200):
        before, e = some() + " ", entity(i % 4)
        base, spans = pii.private_spans(before + e + " " + some(), field)
        if any(b[1] <= len(before) and b[2] >= len(before) + len(e) for b in base):
            continue  # by chance a card
        hit += any(k == i % 4 and len(before) <= x + 2 and y >= len(before) + len(e) - 1 for k, x, y in spans)
        wrong += bool(pii.private_spans(some() + " " + plain[i % 4]() + " " + some(), field)[1])
    assert hit >= 120 and wrong <= 8, (hit, wrong)


def test_field_adds_secrets(spark):
    rows = pii.op9(spark, "/root/testdata/sf0.01").collect()
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    added = {(r.doc_id, *map(int, s.split(":")[1:])) for r in rows if r.secrets for s in r.secrets.split(",")}
    named = {(i, a, b) for i, t in text.items() if t for a, b in pii.secrets(t)}
    assert added and len(added & named) >= 0.8 * max(len(added), len(named))
    assert all(r.n_spans == sum(len(x.split(",")) for x in (r.spans, r.secrets) if x) for r in rows)


def test_repeats(spark, sf, texts):
    want = brute.repeats(texts)
    got = {r.doc_id: r for r in repeats.op10(spark, sf).collect()}
    assert set(got) == set(want) and sum(r.n_removed for r in got.values())
    for i, r in got.items():
        assert (r.n_bytes, r.n_removed, r.n_spans) == want[i][:3] and r.kept_sha256 == hashlib.sha256(want[i][3]).hexdigest()


def test_repeats_in_many_groups(edge, empty):
    docs = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = brute.repeats({r.doc_id: r.text for r in docs.collect()})
    rows = repeats.without_repeats(docs, unit_bytes=20_000, with_text=True).collect()
    assert len(rows) == docs.count() and all((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id] for r in rows)
    assert repeats.without_repeats(edge).count() == edge.count() and repeats.without_repeats(empty).count() == 0


def test_repeats_of_a_recurring_trigger(spark):
    rows = []
    for k in range(1, 9):
        label = ["0"] * 80
        label[5 * k + 18] = str(k % 3 + 1)
        rows.append((k, '{"one_hot_class_label_vector": [' + ", ".join(label) + '], "split": "train"}'))
    rows += [(9, rows[0][1].replace("[0", "[7")), (10, rows[3][1] * 3), (11, rows[3][1])]
    want = brute.repeats(dict(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (repeats.UNIT_BYTES, 400):
        got = repeats.without_repeats(docs, unit_bytes=size, with_text=True).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == want


def test_corpus_order_of_periodic_texts(spark):
    """Few symbols, long runs and near periods: triggers recur and tie, and the order of bytes alone must decide."""
    r = np.random.default_rng(6)
    rows = []
    for i in range(60):
        period = bytes(r.choice(list(b"ab"), r.integers(1, 9))) * 60
        cut = bytearray(period[: r.integers(40, 300)])
        for _ in range(r.integers(0, 3)):
            cut[r.integers(len(cut))] = 99
        rows.append((i, cut.decode()))
    want = brute.repeats(dict(rows))
    for size in (repeats.UNIT_BYTES, 600):
        got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), unit_bytes=size, with_text=True).collect()
        assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got} == want


def test_phrases_hold_every_string():
    import pyarrow as pa

    texts = ["".join(np.random.default_rng(k).choice(list("abc \u00e9"), 400)) for k in range(3)] + ["short", "", None]
    group = repeats.Group(pa.table({"doc_id": list(range(6)), "text": texts}))
    starts = sorted(a - k for a, lo, hi in zip(group.at.tolist(), group.left.tolist(), group.right.tolist()) for k in range(repeats.SIDE - hi, lo + 1))
    want = [x + i for x, n in zip(group.start.tolist(), group.sizes.tolist()) for i in range(max(0, n - 49))]
    assert starts == want


def test_rank_of_suffixes_is_their_order():
    r = np.random.default_rng(7)
    left = r.integers(97, 99, (200, repeats.SIDE)).astype(np.uint8)
    ranks = repeats._ranks(np.zeros(200, np.int64), left[:, ::-1], np.full(200, repeats.SIDE))
    for k in (1, 5, repeats.SIDE):
        suffix = [bytes(x[repeats.SIDE - k :]) for x in left]
        order = {x: i for i, x in enumerate(sorted(set(suffix)))}
        assert [order[x] for x in suffix] == ranks[k].tolist()
