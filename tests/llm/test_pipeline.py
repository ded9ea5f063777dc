"""The corpus pipeline on a small corpus, against its parts and what was planted."""

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(make, spark, tmp_path):
    r = np.random.default_rng(0)
    words = [f"plain{i}" for i in range(3000)]
    line = lambda n: " ".join(r.choice(words, n))
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(line(25) for _ in range(4))
        toxic = i % 4 == 0
        if toxic:
            text = text.replace(" ", " awful ", 5)
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        if i < 160:
            labels.append((i, 1, int(toxic)))
    copy = rows[1][1]
    rows += [(300, copy, "en", "s0", len(copy)), (301, copy.replace("plain", "plain", 1) + " more", "en", "s0", 0), (302, line(30) + "\n" + copy.split("\n")[0], "en", "s1", 0), (303, None, None, None, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        if i < 4:
            assert docs.dtypes == spark.read.parquet(f"{folder}/documents.parquet").dtypes
        path = f"{folder}/out{i}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    clean = {i for i in range(240) if i % 4}
    assert clean <= set(kept["toxicity"]) and not {i for i in range(0, 240, 4)} & set(kept["toxicity"])
    assert clean <= set(kept["line_dedup"]) and 300 not in kept["line_dedup"]
    assert kept["line_dedup"][302]["text"].count("\n") == 0 and kept["line_dedup"][302]["n_chars"] == len(kept["line_dedup"][302]["text"])
    assert clean <= set(kept["ngram_join"])
    assert {"sequence_id", "offset", "length"} <= set(docs.columns)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "packing"]


def test_run_writes_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    clean = {i for i in range(240) if i % 4}
    mixed = corpus_pipeline.mix_sources(spark, corpus_pipeline.drop_near_copies(spark, corpus_pipeline.drop_repeated_lines(spark, corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), folder), folder), folder)
    rows = out.collect()
    assert len([r for r in rows if r["piece"] == 0]) == mixed.count() and {r["doc_id"] for r in rows} <= clean | {302, 303}


@pytest.mark.parametrize("stage", range(5))
def test_stages_of_nothing_and_clashing_columns(make, spark, stage, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    function = corpus_pipeline.STAGES[stage][1]
    assert function(spark, make([]), str(tmp_path)).collect() == []
    docs = make([None, "", "a b c d e f", (None, "g h i j k l"), (2, "a b c d e f"), "long " * 3000], extra=True).withColumnRenamed("lang", "Row2")
    out = function(spark, docs, str(tmp_path))
    out.collect()
    if stage < 4:
        assert out.dtypes == docs.dtypes


def test_run_on_an_empty_table(make, spark, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_copies_go_by_row(make, spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    docs = make([(4, base), (4, "unlike text under the same id"), (2, base + " x"), (2, base)])
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"][:6]) for r in out) == [(2, base[:6]), (4, "unlike")]


def test_near_copies_leave_one(make, spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    docs = make([(4, base), (2, base + " x"), (9, "other text of its own here"), (None, base), (9, "other text of its own here")], extra=True)
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "9", "None"] and out.columns == docs.columns
