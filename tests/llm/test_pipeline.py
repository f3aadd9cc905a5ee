import importlib
import sys

import corpus_pipeline
from llm.conftest import PROSE, documents
from llm.test_packing import check_places
from weftline.llm import packing, queries
from weftline.llm.sql import SQL


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, "")
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, i
            out.collect()


def test_each_stage_takes_effect(spark, tmp_path):
    rows = [(i, f"{' '.join(f'{w}{i}' for w in PROSE.split())} end of it") for i in range(30)]
    near = rows[0][1].replace("end of it", "end of all")
    rows += [
        (100, rows[0][1]),
        (101, near),
        (102, "too short"),
        (103, rows[1][1].replace("end of it", "mail me at jo.doe@example.org, end of it") + " really"),
        (104, "same old words again and again here now " * 30),
        (105, None),
    ]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        left[name] = {r.doc_id: r for r in docs.collect()}
    assert set(left["quality"]) == {*range(30), 100, 101, 103}
    assert set(left["exact"]) == {*range(30), 101, 103}
    assert set(left["near"]) == set(range(30))
    assert all(r.n_chars == len(r.text) for r in left["personal_data"].values())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(30))
    check_places(got, packing.CAPACITY)


def test_entry_lists_all(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert {"pipeline", *queries.QUERIES} <= names and set(SQL) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "weftline.llm" in sys.modules
