import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from layerlab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations", "embeddings")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(map(tuple, x[columns].astype(str).values.tolist())) for x in (want, got)]
    assert rows[0] == rows[1]


def write(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_decisions_of_each_stage(spark, tmp_path, text_of):
    docs, labels = [], []
    for k in range(300):
        words = text_of(k, 60)
        if k % 3 == 0 and k < 240:
            words[5], words[9], words[30], words[31] = "vilea", "vileb", "rotten", "vilec"
        docs.append((k, f"shared header {k % 2}\n" + " ".join(words), "en", "s", 0))
        if k < 240:
            labels.append((k, 1, int(k % 3 == 0)))
    passage = " ".join(text_of(9999, 15))
    docs.append((400, docs[1][1].replace("header", "header") + " more", "en", "s", 0))  # near copy of 1
    docs.append((401, "x\n" + passage + " " + " ".join(text_of(31, 40)), "en", "s", 0))
    docs.append((402, None, None, None, None))
    docs.append((403, "shared header 0", "en", "s", 15))
    write(spark, str(tmp_path), docs, labels, [(1, passage)])
    rows, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = corpus_pipeline.via_parquet(stage(spark, rows, str(tmp_path)), name)
        kept[name] = {r.doc_id for r in rows.collect()}
        if name != "bpe":
            assert rows.schema.names == before.schema.names
    toxic = {k for k in range(0, 240, 3)}
    everything = {d[0] for d in docs}
    assert kept["toxicity"] == everything - toxic
    assert kept["line_dedup"] == kept["toxicity"]
    # 403 lost its only line and is empty now, as 402 is
    assert kept["near_dedup"] == kept["line_dedup"] - {400, 403}
    assert kept["decontaminate"] == kept["near_dedup"] - {401}
    assert kept["bpe"] == kept["decontaminate"]
    assert rows.filter("doc_id = 402").first().n_tokens == 0
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.ids_sha256 for r in out.collect()} == {r.doc_id: r.ids_sha256 for r in rows.collect()}


def test_line_stage_changes_texts_and_lengths(spark, tmp_path):
    docs = [(k, f"Same\nown {k}", "en", "s", 10) for k in range(12)] + [(50, None, "en", "s", None), (None, "same", "en", "s", 4)]
    write(spark, str(tmp_path), docs, [], [])
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_stage(spark, rows, str(tmp_path)).collect()}
    assert out == {**{k: (f"own {k}", len(f"own {k}")) for k in range(12)}, 50: (None, None), None: ("", 0)}


def test_digest_queries_return_all_rows(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op2_order_minhash", "op3_prefix_bpe", "op4_repeats", "op5_secret_scan", "op6_toxicity"):
        assert QUERIES[name](spark, SF).count() == n, name


def test_secret_query_digest(spark):
    rows = QUERIES["op5_secret_scan"](spark, SF).collect()
    base = ("assign", "access", "hex")
    for r in rows:
        own = [s for s in r.spans.split(",") if s.split(":")[0] in base]
        assert r.base_sha256 == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert r.n_assign + r.n_access + r.n_hex == len(own)


def test_stages_carry_columns_of_any_name(spark, tmp_path, text_of):
    docs = [(k, "shared line\n" + " ".join(text_of(k, 30)), "en", "s", 0) for k in range(12)]
    docs += [(20, docs[3][1].upper(), "en", "s", 0), (None, None, None, None, None), (21, "", "en", "s", 0)]
    docs += [docs[5], docs[5], (None, " ".join(text_of(77, 40)), "en", "s", 0)]
    write(spark, str(tmp_path), docs, [(k, 1, k % 2) for k in range(8)], [(1, " ".join(text_of(5, 30)[5:20]))])
    plain = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clashing = ["th", "mark", "cut_text", "cut", "toxicity", "n_lines", "doc", "_row", "_doc", "a.b"]
    ids = F.col("doc_id")
    extra = plain.withColumns({c: F.concat(F.lit(f"{c}:"), ids.cast("string")) for c in clashing})
    for name, stage in corpus_pipeline.STAGES:
        out, wide = stage(spark, plain, str(tmp_path)), stage(spark, extra, str(tmp_path))
        if name == "bpe":
            break
        assert wide.columns == extra.columns and out.columns == plain.columns
        rows = wide.collect()
        assert all(r[c] == (None if r.doc_id is None else f"{c}:{r.doc_id}") for r in rows for c in clashing)
        key = lambda r: tuple(str(r[c]) for c in plain.columns)
        assert sorted(map(key, rows)) == sorted(map(key, out.collect()))
        assert stage(spark, extra.filter("false"), str(tmp_path)).collect() == []
        plain, extra = out, wide


def test_stages_of_null_ids_and_repeated_rows(spark, tmp_path, text_of):
    one, other = " ".join(text_of(1, 50)), " ".join(text_of(2, 50))
    docs = [(1, one, "en", "s", 0)] * 3 + [(None, other, "en", "s", 0)] * 2 + [(2, one + " end", "en", "s", 0), (None, None, None, None, None)]
    write(spark, str(tmp_path), docs, [(1, 1, 0), (2, 1, 0)], [(1, "no such passage in here at all, of that we are sure")])
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = corpus_pipeline.via_parquet(stage(spark, rows, str(tmp_path)), name)
        kept[name] = sorted((str(r.doc_id), str(r.text)) for r in rows.collect())
    everything = sorted((str(d[0]), str(d[1])) for d in docs)
    assert kept["toxicity"] == kept["line_dedup"] == everything
    # rows with one id and text share the verdict; the copy with the larger id goes
    assert kept["near_dedup"] == kept["decontaminate"] == [x for x in everything if x[0] != "2"]
