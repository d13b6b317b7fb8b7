"""Machines, projections and grids against numpy; feature stores and readers on files that the tests write."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import dense, grids, partial, svm
from textloom.plans import registry
from textloom.sources import features


def vectors(spark, x, y, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row], label) for i, (row, label) in enumerate(zip(x, y))], "id long, embedding array<double>, label string").repartition(parts)


def rings(n=300, seed=1):
    """Two rings and a core: no plane separates them."""
    g = np.random.default_rng(seed)
    y = np.arange(n) % 3
    r, a = y * 2.0 + g.normal(scale=0.15, size=n), g.uniform(0, 2 * np.pi, n)
    return np.stack([r * np.cos(a), r * np.sin(a)], 1), np.array(["core", "inner", "outer"])[y]


def test_tree_sum(spark):
    df = spark.range(1000).repartition(17)
    got = partial.tree_sum(df, lambda b: np.array([[len(b), b.column("id").to_numpy().sum()]], float), 17)
    assert got.tolist() == [[1000, 499500]]
    assert partial.tree_sum(df.where("id < 0"), lambda b: np.zeros(1), 1) is None


def test_waves_come_near_the_kernel():
    x = np.random.default_rng(2).normal(size=(40, 3))
    z = svm.mapped(x, *svm.waves(3, 0.4, 20_000))[:, :-1]
    want = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - want).max() < 0.05


def test_minimized_columns_by_themselves():
    """Quadratics of very different scale, each with its own minimum."""
    g = np.random.default_rng(3)
    scale, at = 10.0 ** g.uniform(-2, 3, size=(6, 4)), g.normal(size=(6, 4))
    w = svm.minimized(lambda w: ((scale * (w - at) ** 2).sum(0), 2 * scale * (w - at)), (6, 4), 300, 1e-7)
    assert np.abs(w - at).max() < 1e-3


def test_svm_separates_rings(spark, tmp_path):
    x, y = rings()
    df = vectors(spark, x, y)
    model = svm.fit(df, (0.01, 1.0, 10.0), gamma=0.5, n_waves=256)
    unseen, truth = rings(300, 7)
    rows = vectors(spark, unseen, truth)
    got = {r.id: r.predicted for r in model.predict(rows).collect()}
    assert np.mean([got[i] == truth[i] for i in range(300)]) > 0.97
    assert [r["rank"] for r in model.grid] == [1, 2, 3] and model.grid[0]["mean_macro_f1"] > 0.97 and model.c == model.grid[0]["c"]
    model.save(spark, f"{tmp_path}/svm")
    again = svm.load(spark, f"{tmp_path}/svm")
    assert {r.id: r.predicted for r in again.predict(rows).collect()} == got and again.grid == model.grid
    line = svm.fit(df, kernel="linear", folds=0)
    got = {r.id: r.predicted for r in line.predict(rows).collect()}
    assert np.mean([got[i] == truth[i] for i in range(300)]) < 0.8
    with pytest.raises(ValueError):
        svm.fit(df, kernel="cubic")


def test_svm_is_at_its_minimum(spark):
    """The gradient of every machine is near zero, on all rows; folds hold out what their hash says."""
    x, y = rings(120)
    df = vectors(spark, x, y, 3)
    model = svm.fit(df, (1.0,), gamma=0.5, n_waves=64, folds=0, passes=200)
    z = svm.mapped(x, model.directions, model.phases)
    for k, label in enumerate(model.labels):
        w, sign = model.weights[:, k], np.where(y == label, 1.0, -1.0)
        slack = np.maximum(0, 1 - sign * (z @ w))
        assert np.linalg.norm(w - 2 * z.T @ (sign * slack)) < 0.01 * np.linalg.norm(2 * z.T @ sign)


def test_svm_edges(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "a"), (2, [], "b"), (3, None, "a"), (4, [2.0, 1.0], None), (5, [0.0, 9.0], "b"), (6, [1.0, 2.5], "a")], "id long, embedding array<double>, label string")
    model = svm.fit(df, folds=2, n_waves=32)
    assert model.labels == ["a", "b"] and {r.id for r in model.predict(df).collect()} == {1, 4, 5, 6}


def brute_axes(x, k, mode, whiten):
    if mode == "l2_normalized":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = x - x.mean(0)
    if mode == "standardized":
        c = c / x.std(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    v = v[:k] * np.where(v[np.arange(k), np.abs(v[:k]).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return c @ v.T / (np.sqrt(s[:k] ** 2 / (len(x) - 1)) if whiten else 1.0), s[:k] ** 2 / (len(x) - 1)


@pytest.mark.parametrize("whiten", [False, True])
@pytest.mark.parametrize("mode", dense.MODES)
def test_projection_equals_numpy(spark, tmp_path, mode, whiten):
    g = np.random.default_rng(4)
    x = g.normal(size=(90, 7)) * np.array([5, 3, 2, 1, 0.5, 0.2, 0.1]) + 3
    df = vectors(spark, x, ["a"] * 90)
    p = dense.fit_projection(df, 4, mode, whiten)
    want, variance = brute_axes(x, 4, mode, whiten)
    got = {r.id: r.projected for r in p.project(df).collect()}
    assert np.allclose([got[i] for i in range(90)], want, atol=1e-8) and np.allclose(p.variance, variance)
    p.save(spark, f"{tmp_path}/p")
    again = dense.load_projection(spark, f"{tmp_path}/p")
    assert {r.id: r.projected for r in again.project(df).collect()} == got
    with pytest.raises(ValueError):
        dense.fit_projection(df, 8, mode)


def brute_gaussian(tx, ty, x, smoothing, labels):
    eps = max(smoothing * tx.var(0).max(), 1e-12)
    out = []
    for label in labels:
        c = tx[ty == label]
        m, v = c.mean(0), c.var(0) + eps
        out.append(-0.5 * (np.log(2 * np.pi * v) + (x - m) ** 2 / v).sum(1) + math.log(len(c) / len(tx)))
    return np.array(labels)[np.argmax(out, 0)]


def brute_f1(y, p):
    labels = sorted(set(y) | set(p))
    return float(np.mean([2 * np.sum((y == c) & (p == c)) / (np.sum(y == c) + np.sum(p == c)) for c in labels]))


def test_vector_grid_equals_one_run_after_another(spark, tmp_path):
    g = np.random.default_rng(5)
    y = np.array(list("abc"))[np.arange(240) % 3]
    x = g.normal(size=(240, 6)) * np.array([4, 3, 2, 1, 1, 0.5]) + 0.9 * (np.arange(240) % 3)[:, None]
    part = [slice(0, 140), slice(140, 190), slice(190, 240)]
    frames = [vectors(spark, x[s], y[s]) for s in part]
    frames[1] = frames[1].withColumn("id", F.col("id") + 1000)
    grid, model, tested = grids.vectors_searched(*frames, axes=(2, 4, 99), smoothing=(1e-9, 1e-2))
    assert len(grid) == 3 * 2 * 2 * 2 and [r["place"] for r in grid] == list(range(1, 25))
    tx, ty, vx, vy = x[part[0]], y[part[0]], x[part[1]], y[part[1]]
    for r in grid:
        p = dense.fit_projection(frames[0], r["axes"], r["mode"], r["whiten"])
        spread = np.sqrt(p.variance) if r["whiten"] else 1.0
        onto = lambda v: (dense.prepared(v, p.mode) - p.center) / p.scale @ p.axes.T / spread  # noqa: B023, E731
        assert r["macro_f1"] == pytest.approx(brute_f1(vy, brute_gaussian(onto(tx), ty, onto(vx), r["smoothing"], list("abc"))), abs=1e-6)
    assert tested.sum() == 50 and np.diag(tested).sum() > 25
    model.save(spark, f"{tmp_path}/gaussian")
    rows = frames[2]
    assert {tuple(r) for r in grids.load_gaussian(spark, f"{tmp_path}/gaussian").predict(rows).collect()} == {tuple(r) for r in model.predict(rows).collect()}


def test_word_grid_with_small_limits(spark, sf):
    """Limits that bite, so that the choice of terms is seen, against the SQL."""
    from textloom.operators import sampling as S

    small = ((1, 2), (1, 3), (40, 90), (0.1, 1.0))
    split = S.three_way(registry.posts(spark, sf), "label", "doc_id").select("doc_id", "label", "split")
    got = grids.words_searched(registry.tokens(spark, sf), split, *small).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(registry.word_grid_sql(*small)).df()
    columns = sorted(want.columns)
    rows = lambda f: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in f[columns].itertuples(index=False))
    assert len(got) == 16 and rows(got) == rows(want) and got[got.place == 1].test_macro_f1.notna().all()


def test_word_grid_writes_no_weights(spark, monkeypatch):
    """Only lists of terms are written, however many settings there are; lists that frequent terms do not fill take the rest."""
    written = []
    monkeypatch.setattr(grids, "settled", lambda df, tag="rows": written.append(tag) or df)
    rows = [(i, "ab"[i % 2], ["x", f"w{i}", "ab"[i % 2]]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, label string, tokens array<string>")
    got = grids.words_scored(df, df, (1, 2), (1, 2), (5, 100), (0.1,)).collect()
    assert written == ["terms"] and len(got) == 8 * 20 and all(r.actual == r.predicted for r in got)
    assert {(r.ngram_max, r.min_df, r.max_features): r.retained for r in got} == {(1, 1, 5): 5, (1, 1, 100): 22, (1, 2, 5): 2, (1, 2, 100): 2, (2, 1, 5): 5, (2, 1, 100): 62, (2, 2, 5): 2, (2, 2, 100): 2}


def test_models_by_name(spark):
    from textloom.operators import catalog

    x, y = rings(150)
    train, test = vectors(spark, x, y), vectors(spark, *rings(90, 5))
    got = {r.model: r for r in catalog.compared("vectors", train, test).collect()}
    assert set(got) == set(catalog.MODELS["vectors"]) and got["SVM"].test_macro_f1 > 0.95 > 0.8 > got["Logistic regression"].test_macro_f1
    assert sorted(r["rank"] for r in got.values()) == [1, 2, 3] and all(r.gap == pytest.approx(r.train_macro_f1 - r.test_macro_f1, abs=1e-6) for r in got.values())
    words = spark.createDataFrame([(i, "red apple" if i % 2 else "blue sky", "ab"[i % 2]) for i in range(40)], "id long, text string, label string")
    assert catalog.compared("words", words, words).first().test_accuracy == 1.0
    for bad in (("plots",), ("vectors", "Oracle")):
        with pytest.raises(ValueError):
            catalog.make_models(*bad)


def test_read_cleaned(spark, tmp_path):
    from textloom.sources import tables

    (tmp_path / "p.csv").write_text(''' text ,Unique_ID\n"Rivers, they're <b>deep</b>",1\nn/a,2\n"Rivers, they're <b>deep</b>",3\n''')
    assert [r.tokens for r in tables.read_cleaned(spark, f"{tmp_path}/p.csv").collect()] == [["rivers", "deep"]]
    assert tables.read_cleaned(spark, f"{tmp_path}/p.csv", cleaner=None).count() == 3


# ---------------------------------------------------------------- stores and readers


def test_cache_round_trip_and_mismatch(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 3).alias("k"), F.array(F.lit(1.5), F.col("id").cast("double")).alias("v"), F.lit(None).cast("string").alias("s"))
    folder = f"{tmp_path}/store"
    features.write_cache(df, folder, "k", 8)
    got = features.read_cache(spark, features.resolved(spark, [f"{tmp_path}/none", folder]), "k")
    assert got.schema.simpleString() == df.schema.simpleString() and sorted(map(tuple, got.select("k").collect())) == sorted(map(tuple, df.select("k").collect()))
    other = f"{tmp_path}/other"
    features.write_cache(df.select("k", F.lit(1).alias("w")), other, "k", 8)
    joined = features.joined_by_key(got, features.read_cache(spark, other), "k")
    assert joined.count() == 500
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(features.CacheMismatch):
        features.read_cache(spark, folder, "s")
    with pytest.raises(features.CacheMismatch):
        features.joined_by_key(got, df.limit(499), "k")
    with pytest.raises(features.CacheMismatch):
        features.write_cache(spark.range(1).select(F.lit(None).cast("long").alias("k")), f"{tmp_path}/null", "k")
    with pytest.raises(FileNotFoundError):
        features.resolved(spark, [f"{tmp_path}/none"])
    df.limit(3).write.mode("append").parquet(f"{folder}/rows")
    with pytest.raises(features.CacheMismatch):
        features.read_cache(spark, folder)


def test_side_by_side(spark):
    left = spark.range(1000).select(F.col("id").alias("a")).repartition(7)
    right = spark.range(1000).select((2000 - F.col("id")).alias("b")).repartition(3)
    got = features.joined_by_position(left, ["a"], right, ["b"]).collect()
    assert len(got) == 1000 and all(r.b - r.a == 1001 and r.position == r.a for r in got)
    with pytest.raises(features.CacheMismatch):
        features.joined_by_position(left, ["a"], right.limit(5), ["b"])
    with pytest.raises(features.CacheMismatch):
        features.joined_by_position(left, ["a"], left, ["a"])


def test_grouped_fill_over_splits(spark, tmp_path):
    """Several files, each of several splits; a block's only value stands splits before its last rows."""
    want, model, split = [], None, None
    for f in range(3):
        lines = [" Model ,Split,Class,Recall"]
        for i in range(400):
            n = f * 400 + i
            model, new = (f"m{n}", f" m{n} ") if n % 150 == 20 else (model, " ")
            split, part = ("Test" if n % 130 < 65 else "Train", " Test" if n % 130 < 65 else "Train") if n % 65 == 0 else (split, "")
            recall = "" if n % 7 == 0 else "x" if n % 11 == 0 else f"{n / 10}"
            lines.append(f"{new},{part},c{n},{recall}")
            if split == "Test" and recall:
                want.append((model, f"c{n}", None if recall == "x" else n / 10))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part-{f}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = features.read_grouped(spark, f"{tmp_path}/in", ["Model", "Split"], ["Recall"], ["Class"], {"Split": "test"})
        assert spark.read.csv(f"{tmp_path}/in").select("_metadata.file_block_start").distinct().count() > 3
        rows = [(r.Model, r.Class, r.Recall) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # A cell that is no number is null as a number; only blank classes go.
    blank = {(m, c) for m, c, _ in rows} - {(m, c) for m, c, _ in want}
    assert {r for r in rows if (r[0], r[1]) not in blank} == set(want) and all(int(c[1:]) % 7 == 0 for _, c in blank)
    with pytest.raises(ValueError):
        features.read_grouped(spark, f"{tmp_path}/in", ["Vectorizer"], [], [])


def test_config(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("# settings\nepochs: 5\nrate: 0.1  # slow\nname: 'bert'\nnested:\n  deep: 1\nlist: [1, 2]\n")
    (tmp_path / "a.json").write_text('{"epochs": 5}')
    assert features.read_config(spark, f"{tmp_path}/a.yaml") == {"epochs": 5, "rate": 0.1, "name": "bert", "nested": "", "list": [1, 2]}
    assert features.read_config(spark, f"{tmp_path}/a.json") == {"epochs": 5}


# ---------------------------------------------------------------- exports


def test_csv_with_mark_and_arrays(spark, tmp_path):
    from textloom.sources import exports

    df = spark.createDataFrame([(1, ["a", "b"], 'say "hi", you'), (2, None, None)], "id int, tokens array<string>, text string").coalesce(1)
    exports.write_csv(df, f"{tmp_path}/out", bom=True)
    raw = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfid,tokens,text") and raw.count(b"\xef\xbb\xbf") == 1
    back = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/out").collect()
    assert [tuple(r) for r in back] == [("1", '["a","b"]', 'say "hi", you'), ("2", None, None)]
    exports.write_tables(f"{tmp_path}/tables", first=df.select("id"), second=df.select("text"))
    assert len(list((tmp_path / "tables" / "first").glob("*.csv"))) == 1


def test_modelling_set(spark, tmp_path):
    from textloom.sources import exports

    rows = [(i, "raw", "clean", " " if i % 5 == 0 else "words", "u" if i % 2 else "v", "l", "n") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id int, raw_text string, clean_text string, analysis_text string, umbrella string, label_clean string, label_normalized string")
    exports.export_modelling(df.repartition(4), "doc_id", f"{tmp_path}/m")
    got = spark.read.parquet(f"{tmp_path}/m/rows")
    assert sorted(r.record_id for r in got.collect()) == [i + 1 for i in range(100) if i % 5]
    classes = spark.read.option("header", True).csv(f"{tmp_path}/m/classes").collect()
    assert [tuple(r)[1:] for r in classes] == [("40", "50.0")] * 2
    with pytest.raises(ValueError):
        exports.modelling_set(df.drop("umbrella"), "doc_id")


def test_modelling_set_with_numbers_moves_no_text(spark):
    from textloom.sources import exports

    df = spark.createDataFrame([(7, 1, "raw", "clean", "", "u", "l", "n"), (8, 2, "raw", "clean", "w", "u", "l", "n")], "record_id int, doc_id int, raw_text string, clean_text string, analysis_text string, umbrella string, label_clean string, label_normalized string")
    got = exports.modelling_set(df, "doc_id")
    assert [r.record_id for r in got.collect()] == [8] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_summary_lines_and_log(spark, tmp_path):
    from textloom.sources import exports

    df = spark.createDataFrame([("a", 1, ["x", "x"]), ("a", 3, ["y"]), ("b", 5, None), (None, 7, ["x"])], "label string, n int, found array<string>")
    lines = exports.feature_lines(df, "label", "n")
    exports.write_lines(lines, f"{tmp_path}/s")
    assert next((tmp_path / "s").glob("*.txt")).read_text().splitlines() == [
        "rows: 4", "labels: 2", "n: count 4, mean 4.00, std 2.58, min 1.00, max 7.00", "a: rows 2", "a: mean n 2.00", "b: rows 1", "b: mean n 5.00", "null: rows 1", "null: mean n 7.00",
    ]
    log = {(r.kind, r.label, r.found): (r.n, r.posts) for r in exports.found_log(df, "label", emoji="found").collect()}
    assert log == {("emoji", "a", "x"): (2, 1), ("emoji", "a", "y"): (1, 1), ("emoji", None, "x"): (1, 1)}
