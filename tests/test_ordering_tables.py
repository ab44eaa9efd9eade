import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import CODE_DOMAINS, SURVEY_BINARY, SURVEY_DOMAINS, SURVEY_FIELDS, SURVEY_RANGES
from layerlab.operators import tables as TB
from layerlab.plans import materialize as M
from layerlab.plans.ordering import dense_positions, exact_quantiles, running_sums, smallest_k


def skewed(spark, n=5000):
    """A third of the rows in one group, sparse and negative keys, null groups."""
    k = (F.col("id") - 2000) * 7_000_003
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 5).cast("string"))
    return spark.range(n).select(k.alias("k"), g.alias("g"), (F.col("id") % 11).alias("v"))


def test_running_sums_and_positions(spark):
    df = skewed(spark)
    got = running_sums(df, "k", {"s": F.col("v"), "n": F.lit(1)}, ["g"]).toPandas().sort_values(["g", "k"])
    grouped = got.groupby("g", dropna=False)
    assert len(got) == 5000
    assert (got["n"] == grouped.cumcount()).all()
    assert (got["s"] == grouped["v"].cumsum() - got["v"]).all()
    all_rows = dense_positions(df, "k", "p").toPandas().sort_values("k")
    assert (all_rows["p"].to_numpy() == np.arange(5000)).all()


def test_split_sizes_and_determinism(spark):
    df = skewed(spark)
    a = {(r.k, r.split) for r in TB.random_split(df, "k").collect()}
    b = {(r.k, r.split) for r in TB.random_split(df.repartition(3), "k").collect()}
    assert a == b
    assert sum(s == "test" for _, s in a) == math.ceil(0.2 * 5000)
    s = TB.stratified_split(df, "k", "g").toPandas()
    sizes = s.groupby("g", dropna=False)["split"].agg(["size", lambda x: (x == "test").sum()])
    assert len(s) == 5000
    for size, test in sizes.to_numpy():
        assert test == math.ceil(0.2 * size)


def test_stratified_falls_back(spark):
    df = spark.createDataFrame([(i, 0) for i in range(9)] + [(99, 1)], "k long, label int")
    out = TB.stratified_split(df, "k").toPandas()
    assert (out.split == "test").sum() == 2


def test_smallest_k_matches_sort(spark):
    df = skewed(spark)
    got = smallest_k(df, "k", 7, F.least(F.lit(100).cast("long"), F.col("n")), "sel", ["g"]).toPandas()
    import hashlib

    got["h"] = [hashlib.md5(f"7:{k}".encode()).hexdigest() for k in got["k"]]
    for _, part in got.groupby("g", dropna=False):
        want = set(part.sort_values(["h", "k"]).head(100)["k"])
        assert set(part[part.sel]["k"]) == want
    small = TB.sample_rows(df, "k", 100, 7, ["g"])
    assert small.count() == got["sel"].sum()
    assert TB.sample_rows(df, "k", 10_000).count() == 5000


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(0, 1, 900)] + [("a", 1e9)]
    rows += [("b", 0.0)] * 400 + [("b", float(x)) for x in rng.integers(0, 3, 100)] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = exact_quantiles(df, ["g"], "x", [0.25, 0.5, 0.9], ["a", "b", "c"]).toPandas()
    assert len(got) == 3
    for r in got.itertuples():
        values = [x for g, x in rows if g == r.g or (g is None and r.g is None)]
        np.testing.assert_allclose([r.a, r.b, r.c], np.percentile(values, [25, 50, 90]), rtol=1e-12)
    whole = exact_quantiles(df, [], "x", [0.5], ["m"]).first()[0]
    assert whole == pytest.approx(np.median([x for _, x in rows]))


def test_exact_quantiles_of_any_doubles(spark):
    rng = np.random.default_rng(3)
    wide = [float(s * 2.0**e) for e in range(-1000, 1001, 7) for s in (1, -1, 1.0000000000000002)]
    near = [float(x) for x in np.nextafter(1.0, 2.0) + np.arange(300) * 2.0**-52]
    sets = {
        "wide": [*wide, float("inf"), float("-inf"), 5e-324, -5e-324],
        "near": near,
        "zeros": [0.0, -0.0] * 50,
        "ties": [7.5] * 5000 + [float(x) for x in rng.normal(7.5, 1e-9, 99)],
        "one": [3.25],
        "nan": [float("nan"), 1.0, 2.0],
    }
    df = spark.createDataFrame([(g, x) for g, v in sets.items() for x in v] + [("none", None)], "g string, x double")
    probs, names = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0], list("abcdef")
    got = {r.g: r for r in exact_quantiles(df, ["g"], "x", probs, names).collect()}
    assert set(got) == set(sets)
    for g, values in sets.items():
        ordered = sorted(v for v in values if v == v) + [v for v in values if v != v]
        for p, name in zip(probs, names):
            pos = p * (len(ordered) - 1)
            lo, hi = ordered[int(np.floor(pos))], ordered[int(np.ceil(pos))]
            want = lo if lo == hi or (lo != lo and hi != hi) else lo + (hi - lo) * (pos - np.floor(pos))
            np.testing.assert_equal(got[g][name], want + 0.0, err_msg=f"{g} {p}")
    assert exact_quantiles(df.filter("false"), ["g"], "x", [0.5], ["m"]).count() == 0


def test_inline_if_small(spark):
    df = spark.range(50)
    assert M.inline_if_small(df, 10) is df
    assert M.inline_if_small(df, 50).count() == 50
    assert M.cut_lineage(df).count() == 50
    assert M.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_dedup_keeps_first(spark):
    rows = [(0, "a", "x"), (1, "a", "x"), (2, None, "x"), (3, None, "x"), (4, "a", "y")]
    df = spark.createDataFrame(rows, "row_id long, t string, s string")
    assert {r.row_id for r in TB.dedup_rows(df).collect()} == {0, 2, 4}
    assert {r.row_id for r in TB.dedup_rows(df, ignore=["s"]).collect()} == {0, 2}
    kept = TB.dedup_rows(df, ignore=["t"]).orderBy("row_id").collect()
    assert [(r.row_id, r.t) for r in kept] == [(0, "a"), (4, "a")]


def test_union_of_splits_by_one_prefix_sum(spark, tmp_path):
    far = [0, 1, 1 << 20, 1 << 33, (1 << 41) + 5, 1 << 62]
    frames = {}
    for name, places in (("z", far), ("none", []), ("a", far[::-1] + [7])):
        spark.createDataFrame([(p, f"{name}{p}") for p in places], "pos long, v string").write.parquet(str(tmp_path / name))
        frames[name] = spark.read.parquet(str(tmp_path / name))
    out = TB.union_splits(frames, "pos")
    got = [(r.row_id, r.split, r.pos) for r in out.orderBy("row_id").collect()]
    assert [g[0] for g in got] == list(range(13))
    assert [g[1:] for g in got] == [("z", p) for p in sorted(far)] + [("a", p) for p in sorted([*far, 7])]
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # each split is read for the digits and for the rows; the digits are reused
    assert len(frames) <= plan.count("FileScan parquet") <= 2 * len(frames)


def test_union_order(spark):
    a = spark.createDataFrame([(5, "p"), (9, "q")], "pos long, t string")
    b = spark.createDataFrame([(1, "r")], "pos long, t string")
    out = TB.union_splits({"train": a, "test": b}, "pos").orderBy("row_id").collect()
    assert [(r.row_id, r.split, r.t) for r in out] == [(0, "train", "p"), (1, "train", "q"), (2, "test", "r")]


def test_missing_layers(spark):
    have = spark.createDataFrame([(0,), (1,)], "layer int")
    TB.require_layers(spark.createDataFrame([(1,)], "layer int"), have)
    with pytest.raises(ValueError, match="7"):
        TB.require_layers(spark.createDataFrame([(1,), (7,)], "layer int"), have)


def test_batches(spark):
    vec = TB.assign_batch(spark.range(35).withColumnRenamed("id", "row_id"))
    lab = TB.assign_batch(spark.range(20).withColumnRenamed("id", "row_id"))
    report = {r.batch_idx: (r.n_vectors, r.n_labels, r.kept, r.mismatch) for r in TB.batch_mismatch(vec, lab).collect()}
    assert report == {0: (16, 16, 16, False), 1: (16, 4, 4, True), 2: (3, 0, 0, True)}
    assert TB.align_batches(vec, lab.drop("row_id")).count() == 20
    todo = TB.skip_done_batches(vec, 1, vec.filter("batch_idx = 1"))
    assert {r.batch_idx for r in todo.collect()} == {2}


def test_codes_and_domains(spark):
    assert len(SURVEY_FIELDS) == 42 and len(CODE_DOMAINS) == 14 and len(CODE_DOMAINS["country"]) == 37
    assert set(SURVEY_DOMAINS.values()) == set(CODE_DOMAINS)
    df = spark.createDataFrame([(1,), (7,), (99,), (None,)], "EMOT int")
    got = [r.o for r in df.select(TB.decode(F.col("EMOT"), CODE_DOMAINS["emotion"]).alias("o")).collect()]
    assert got == ["JOY", "GUILT", None, None]
    joined = TB.lookup_dimension(df, TB.domain_table(spark, CODE_DOMAINS), "emotion", "EMOT", "o")
    assert {(r.EMOT, r.o) for r in joined.collect()} == {(1, "JOY"), (7, "GUILT"), (99, None), (None, None)}
    words = spark.createDataFrame([("joy",), ("anger",), ("joy",), (None,)], "e string")
    coded = {(r.e, r.code) for r in TB.encode_labels(words, "e").collect()}
    assert coded == {("anger", 0), ("joy", 1), (None, None)}


def test_range_rules(spark):
    df = spark.createDataFrame([(1, 0), (9, 1), (None, 3)], "INTS int, EXP1 int")
    got = {r.rule: (r.checked, r.violations) for r in TB.range_check(df, {"INTS": SURVEY_RANGES["INTS"]}, [SURVEY_BINARY[0]]).collect()}
    assert got == {"INTS": (2, 1), "EXP1": (3, 1)}
    flags = TB.range_flags(df, {"INTS": (1, 4)}).select("INTS_ok").collect()
    assert [r[0] for r in flags] == [True, False, None]


def test_shapes(spark):
    df = spark.createDataFrame([(1, [1.0], [2.0])], "id int, layer_0 array<double>, layer_10 array<double>")
    packed = TB.pack_layers(df)
    long = TB.melt_layers(packed).orderBy("layer").collect()
    assert [(r.layer, r.vec) for r in long] == [(0, [1.0]), (10, [2.0])]
    assert sorted(r.layer for r in TB.melt_layer_columns(df).collect()) == [0, 10]
    padded = TB.pad_labels_in_batch(
        spark.createDataFrame([(0, [1]), (0, [2, 3]), (1, [4])], "batch_idx int, labels array<int>")
    )
    assert sorted(r.labels for r in padded.collect()) == [[1, 0], [2, 3], [4]]


def test_hash_bins_stay_small():
    from layerlab.plans.ordering import BIN_ROWS, hash_digits

    for rows in (0, 10**6, 10**9, 10**12, 10**15):
        assert rows / 16 ** hash_digits(rows) <= BIN_ROWS / 2
    assert hash_digits(10**9) == 3 and 16 ** hash_digits(10**12) <= BIN_ROWS * 16


def test_scratch_folder_is_removed(spark):
    import os

    with M.scratch(spark) as folder:
        kept = M.via_parquet(spark.range(5), "numbers")
        assert kept.count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    assert not M.scratch_path(spark, "x").startswith(folder)
