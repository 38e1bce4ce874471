import random
import re

import corpus_pipeline
from tests.llm.test_models import BAD, SYLLABLES, sentence


def tables(spark, path):
    draw, rows, labels = random.Random(11), [], []
    for i in range(400):
        lang = draw.choice(sorted(SYLLABLES))
        text = sentence(lang, draw, draw.randrange(30, 90)).split()
        bad = i % 8 == 0
        if bad:
            for word in BAD:
                text.insert(draw.randrange(len(text)), word)
        rows.append((i, " ".join(text), lang, f"s{i % 3}"))
        labels.append((i, 0, int(bad)))
    rows += [(400 + k, rows[k + 1][1], rows[k + 1][2], "s0") for k in range(6)]  # copies of 1 .. 6
    rows += [(500, None, "aa", "s0"), (501, "12345 !!", "aa", "s1")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def test_each_stage_takes_effect(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/out_{name}")
        docs = seen[name] = spark.read.parquet(f"{path}/out_{name}")
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert not {500, 501} & set(ids["language"]) and len(ids["language"]) >= 400
    clean = {i for i in range(400) if i % 8}
    assert not {i for i in range(400) if i % 8 == 0} & set(ids["toxicity"]) and clean <= set(ids["toxicity"])
    assert not {400 + k for k in range(6) if (k + 1) % 8} & set(ids["near_duplicates"]) and clean <= set(ids["near_duplicates"])
    assert set(ids["mixing"]) <= set(ids["near_duplicates"]) and len(ids["mixing"]) != len(set(ids["mixing"]))
    words = seen["mixing"].selectExpr("sum(size(split(text, ' ')))").collect()[0][0]
    assert seen["packing"].selectExpr("sum(length)").collect()[0][0] == words


def test_run_and_registration(spark, tmp_path):
    import __spark_entry__ as entry

    tables(spark, str(tmp_path))
    got = entry.queries()["pipeline"](spark, str(tmp_path))
    assert got.count() > 300 and set(got.columns) >= {"doc_id", "bin_id", "capacity", "offset"}
    assert {f"op{n}_" for n in range(1, 11)} == {f"{k.split('_')[0]}_" for k in entry.queries() if re.match(r"op\d", k)}


def test_awkward_and_empty_tables_pass_every_stage(spark, tmp_path):
    from tests.llm.cases import awkward, empty

    for name, make in (("awkward", awkward), ("empty", empty)):
        path = str(tmp_path / name)
        own = make(spark).selectExpr("*", "map('k', doc_id) as m", "'mine' as rejected", "'mine' as predicted", "'mine' as lang_pred", "'mine' as _found", "'mine' as copies", "'mine' as component_id")
        own.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 0, 0), (6, 0, None), (8, 1, 0)] if name == "awkward" else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        for stage, run in corpus_pipeline.STAGES:
            out = run(spark, docs, path)
            if stage != "packing":
                assert out.columns == docs.columns
                rows = out.collect()
                assert all(r.score == -1.0 and r.rejected == r.predicted == r.lang_pred == r["_found"] == "mine" and r.m == {"k": r.doc_id} for r in rows)
                whole = {(r.doc_id, r.text, r.source) for r in own.collect()}
                assert {(r.doc_id, r.text, r.source) for r in rows} <= whole
            out.write.parquet(f"{path}/out_{stage}")
            docs = spark.read.parquet(f"{path}/out_{stage}")
        assert (docs.count() > 0) == (name == "awkward")


def test_rows_that_differ_only_in_a_map_stay_apart(spark):
    from siltstone.llm.mixing import mixed

    df = spark.createDataFrame([(1, "a b c", "s", {"a": 1}), (1, "a b c", "s", {"a": 2})], "doc_id long, text string, source string, m map<string,int>")
    assert sorted(r.m["a"] for r in mixed(df).collect()) == [1, 2]


def test_the_driver_gives_back_what_models_took(spark, tmp_path, monkeypatch):
    import psutil

    from siltstone.llm.common import give_back

    held = [bytearray(3000) for _ in range(60_000)]
    kept, full = held[::50], psutil.Process().memory_info().rss  # what is kept lies between what is freed
    del held
    give_back()
    assert kept and psutil.Process().memory_info().rss < full - 100e6
    calls = []
    monkeypatch.setattr(corpus_pipeline, "give_back", lambda: calls.append(1))
    tables(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:2]:
        stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert len(calls) == 2
