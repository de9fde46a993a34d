from __future__ import annotations

import random

import corpus_pipeline

import __spark_entry__


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    passage, item = make(60), make(25)
    clean = {i: make(80) for i in range(120)}
    docs = dict(clean)
    docs |= {i: make(60) + " idiot scum moron idiot scum" for i in range(200, 260)}
    near = make(200)
    docs |= {300 + k: near.replace(near.split()[k], f"x{k}", 1) for k in range(5)}
    docs |= {400 + k: make(30) + " " + passage + " " + make(30) for k in range(3)}
    docs |= {500: make(20) + " " + item + " " + make(9), 600: None, 601: ""}
    rows = [(i, t, "en", "s", len(t or ""), "mine") for i, t in docs.items()]
    spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, toxic_score string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 260)) for i in docs], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()}
    assert set(clean) <= set(got) and all(got[i]["text"] == t for i, t in clean.items())
    assert not any(200 <= i < 260 for i in got) and 500 not in got
    assert [i for i in got if 300 <= i < 310] == [300]
    assert all(passage not in got[400 + k]["text"] and got[400 + k]["n_chars"] == len(got[400 + k]["text"]) for k in range(3))
    assert got[600]["text"] is None and got[600]["token_ids"] == [] and 601 in got
    assert len(corpus_pipeline.STAGES) == 5


def test_no_documents_and_no_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, ddl in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    rows = [(None, t, "en", "s", 1) for t in ("same words here", "same words here", "other words", None, None, " ", "")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted(str(r["text"]) for r in kept) == sorted(["same words here", "other words", "None", "None", " ", ""])
