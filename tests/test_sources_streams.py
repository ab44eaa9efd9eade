import json

import pytest
from pyspark.sql import functions as F

from layerlab.functions.fixed_values import SURVEY_FIELDS
from layerlab.plans import corpora as corpora_plan
from layerlab.sources import corpora, layer_files, sinks
from layerlab.streaming import layer_streams


def batch(n, width=2, layers=2):
    return [{f"layer_{k}": [float(i + k)] * width for k in range(layers)} for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    for b, n in ((0, 3), (2, 2), (10, 1)):
        (tmp_path / f"labmodel_my_set_{b}.json").write_text(json.dumps(batch(n), indent=2))
    (tmp_path / "labmodel_my_set_3.json").write_text("[]")
    (tmp_path / "labmodel_my_set_4.json").write_text("{broken")
    (tmp_path / "all_hidden_states_x_1.json").write_text(json.dumps(batch(9)))
    (tmp_path / "notes.txt").write_text("no")
    return str(tmp_path)


def test_labelled_csv(spark, tmp_path):
    for name, rows in (("train", 2), ("test", 1), ("validation", 1)):
        lines = ["text,labels,id"] + [f'"line ""one""\nand, two {i}",[6 7],{name}{i}' for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    out = corpora.read_labelled_splits(spark, *[str(tmp_path / f"{n}.csv") for n in ("train", "test", "validation")])
    got = sorted((r.split_ord, r.id, r.text, r.labels) for r in out.collect())
    assert got[0] == (0, "train0", 'line "one"\nand, two 0', "[6 7]")
    assert [g[1] for g in got] == ["train0", "train1", "test0", "validation0"]


def test_survey_with_trailing_separator(spark, tmp_path):
    values = {"ID": "1", "EMOT": "7", "SIT": "When I, said: 'x'", "MYKEY": "k", "STATE": "s"}
    header = "|".join(SURVEY_FIELDS) + "|"
    row = "|".join(values.get(f, "3") for f in SURVEY_FIELDS) + "|"
    path = tmp_path / "survey.csv"
    path.write_text(f"{header}\n{row}\n")
    df = corpora.read_survey(spark, str(path))
    r = df.first()
    assert len(df.columns) == 42 and (r.ID, r.EMOT, r.SIT, r.COUN) == (1, 7, "When I, said: 'x'", 3)


def test_batch_files(spark, folder):
    batches = layer_files.list_batches(spark, folder, "labmodel", "my_set").orderBy("batch_idx").collect()
    assert [r.batch_idx for r in batches] == [0, 2, 3, 4, 10]
    samples = layer_files.read_layer_vectors(spark, folder)
    assert samples.count() == 6
    first = samples.filter("batch_idx = 0").orderBy("pos").collect()
    assert [r.layers["layer_1"] for r in first] == [[1.0, 1.0], [2.0, 2.0], [3.0, 3.0]]
    assert [r.file_name for r in layer_files.bad_files(spark, folder).collect()] == ["labmodel_my_set_4.json"]
    counts = layer_files.count_samples(samples, ["model", "dataset"]).first()
    assert (counts.n_files, counts.estimated_samples, counts.n_samples) == (3, 48, 6)
    shown = layer_files.preview(samples.withColumn("sample_id", F.col("batch_idx") * 16 + F.col("pos")), 1, 1, 1).collect()
    assert [(r.name, r.length, r.value) for r in shown] == [("layer_0", 2, 0.0)]


def test_file_names(spark):
    names = ["bert-base_news_de_12.json", "gpt2_x.json", "m_d_last.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in layer_files.parse_file_name(F.col("n")).items()]).collect()]
    assert got == [("bert-base", "news_de", 12), ("gpt2", "", None), ("m", "d", None)]


def test_written_batches_read_back(spark, tmp_path):
    rows = [("a/b", "set", i // 2, i % 2, {"layer_0": [float(i)]}) for i in range(5)]
    df = spark.createDataFrame(rows, "model string, dataset string, batch_idx int, pos int, layers map<string,array<double>>")
    path = str(tmp_path / "out")
    sinks.write_batch_files(df, path)
    back = layer_files.read_layer_vectors(spark, path).collect()
    assert sorted((r.model, r.batch_idx, r.pos, r.layers["layer_0"][0]) for r in back) == [("ab", i // 2, i % 2, float(i)) for i in range(5)]


def test_vector_table_prunes(spark, tmp_path):
    rows = [("a/b", "set", k, i // 16, i, [float(i)]) for i in range(64) for k in range(3)]
    df = spark.createDataFrame(rows, "model string, dataset string, layer int, batch_idx int, sample_id long, vec array<double>")
    path = str(tmp_path / "vectors")
    sinks.write_layer_vectors(df, path)
    some = spark.read.parquet(path).filter("layer = 1 AND batch_idx = 2")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 16
    assert "PartitionFilters: [isnotnull(layer" in plan and "EqualTo(batch_idx,2)" in plan


def test_trials_results_summary(spark, tmp_path):
    log = str(tmp_path / "log")
    one = spark.createDataFrame([(1, "t", {"lr": "0.1"}, {"accuracy": 0.5}, "done")], sinks.TRIAL_SCHEMA)
    sinks.append_trial_log(one, log)
    sinks.append_trial_log(one.withColumn("trial_id", F.lit(2).cast("long")), log)
    assert sorted(r.trial_id for r in sinks.read_trial_log(spark, log).collect()) == [1, 2]
    res = str(tmp_path / "res")
    sinks.save_results(one, res)
    sinks.save_results(one, res)
    assert sinks.load_results(spark, res).count() == 1
    sinks.write_summary_csv(spark.createDataFrame([(0, 0.5)], "Layer int, Acc double"), str(tmp_path / "sum"))
    text = next((tmp_path / "sum").glob("*.csv")).read_text()
    assert text.splitlines() == ["Layer,Acc", "0,0.5"]
    assert sinks.storage_target("d", "/mnt/", "disk") == "/mnt/disk/d" and sinks.storage_target("d") == "d"


def test_stream_resumes(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    table, state = str(out / "table"), str(out / "state")
    layer_streams.ingest_batches(spark, folder, table, state, max_files=2)
    assert layer_streams.read_vectors(spark, table).count() == 12
    layer_streams.ingest_batches(spark, folder, table, state)
    assert layer_streams.read_vectors(spark, table).count() == 12
    with open(f"{folder}/labmodel_my_set_11.json", "w") as f:
        json.dump(batch(4), f)
    with open(f"{folder}/labmodel_my_set_12.json", "w") as f:
        f.write('[{"layer_0": [1.0')
    layer_streams.ingest_batches(spark, folder, table, state)
    assert layer_streams.read_vectors(spark, table).count() == 20
    errors = sorted(r.file_name for r in layer_streams.read_errors(spark, table).collect())
    assert errors == ["labmodel_my_set_12.json", "labmodel_my_set_4.json"]


def test_completed_file_is_in_one_table(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    table, state = str(out / "table"), str(out / "state")
    layer_streams.ingest_batches(spark, folder, table, state)
    before = layer_streams.read_vectors(spark, table).count()
    with open(f"{folder}/labmodel_my_set_4.json", "w") as f:
        json.dump(batch(5), f)
    for _ in range(2):  # the second run reads nothing twice
        layer_streams.ingest_batches(spark, folder, table, state)
        vectors = layer_streams.read_vectors(spark, table)
        assert vectors.count() == before + 10
        assert vectors.filter("batch_idx = 4").count() == 10
        assert layer_streams.read_errors(spark, table).count() == 0


def test_batch_run_again_replaces_itself(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    table, state = str(out / "table"), out / "state"
    layer_streams.ingest_batches(spark, folder, table, str(state), max_files=2)
    want = sorted(map(str, layer_streams.read_vectors(spark, table).collect()))
    errors = layer_streams.read_errors(spark, table).count()
    # as after a crash between the write and the commit of the last batch
    last = max((state / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    layer_streams.ingest_batches(spark, folder, table, str(state), max_files=2)
    assert sorted(map(str, layer_streams.read_vectors(spark, table).collect())) == want
    assert layer_streams.read_errors(spark, table).count() == errors == 1


def test_stream_stats_stay_current(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "stats", "state"))
    schema = "layer int, vec array<double>"
    spark.createDataFrame([(0, [1.0, 3.0])], schema).write.parquet(source)
    stream = lambda: layer_streams.vector_stream(spark, source, spark.read.parquet(source).schema)
    layer_streams.stream_layer_stats(stream(), table, state)
    assert layer_streams.latest_layer_stats(spark, table).first().value_mean == 2.0
    spark.createDataFrame([(0, [5.0, 7.0])], schema).write.mode("append").parquet(source)
    layer_streams.stream_layer_stats(stream(), table, state)
    r = layer_streams.latest_layer_stats(spark, table).first()
    assert (r.n_values, r.value_mean, r.value_max) == (4, 4.0, 7.0)


def test_stream_stats_far_from_zero(spark):
    df = spark.createDataFrame([(0, [1e8]), (0, [1e8 + 1])], "layer int, vec array<double>")
    assert layer_streams.running_layer_stats(df).first().value_std == 0.5


def test_corpora_end_to_end(spark, tmp_path):
    paths = []
    for name, lines in (
        ("train", ["So HAPPY :),[17],a", "So HAPPY :),[17],a", "no..,[3 2],b"]),
        ("test", ["no..,[3 2],b", "x = y!,[],c"]),
        ("validation", [",[27],d"]),
    ):
        path = tmp_path / f"{name}.csv"
        path.write_text("\n".join(["text,labels,id", *lines]) + "\n")
        paths.append(str(path))
    got = corpora_plan.labelled_corpus(spark, *paths).orderBy("row_id").collect()
    assert [(r.row_id, r.split, r.clean_text, r.labels) for r in got] == [
        (0, "train", "so happy happy", "[17]"),
        (2, "train", "no..", "[3 2]"),
        (4, "test", "x equal y!", "[]"),
        (5, "validation", "", "[27]"),
    ]
    classes = corpora_plan.labelled_classes(spark, *paths).orderBy("row_id").collect()
    assert [r.dominant_emotion for r in classes] == ["joy", "anger", "admiration", "neutral"]
    assert [r.annoyance for r in classes] == [0, 1, 0, 0]
    row = "|".join({"EMOT": "2", "SIT": "I was, like :( scared!"}.get(f, "1") for f in SURVEY_FIELDS) + "|"
    survey = tmp_path / "survey.csv"
    survey.write_text("|".join(SURVEY_FIELDS) + "|\n" + row + "\n" + row + "\n")
    got = corpora_plan.survey_corpus(spark, str(survey)).collect()
    assert [(r.clean_text, r.labels) for r in got] == [("i was like sad scared", 2)]
    smile = tmp_path / "smile.csv"
    smile.write_text("text,labels,id\nok 😸!,[1],e\n")
    for emoji, clean in ((None, "ok !"), ({"😸": "grinning_cat"}, "ok grinningcat!")):
        got = corpora_plan.labelled_corpus(spark, str(smile), *paths[1:], emoji=emoji).filter("split = 'train'").collect()
        assert [r.clean_text for r in got] == [clean]
