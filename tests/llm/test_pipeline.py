"""Every stage of the pipeline by itself: odd rows, repeated rows, clashing columns, empty tables, and what each decision does."""

import importlib.util
from pathlib import Path

import pytest

spec = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
corpus_pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(corpus_pipeline)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, label int, n long, spans string, component_id long, tie int, row string, _at string, key long, rank int"
REST = ("en", "web", 1, 0.5, 1, 2, "s", 3, 4, "r", "a", 5, 6)


def frame(spark, rows):
    return spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA)


PLAIN = [r"The river runs slowly past the old mill where the farmers bring their wheat every autumn and wait for the wheel to turn again.", "Our engine reads a table of orders, sorts it by day and counts what each customer has bought since spring began last year."]
ODD = [(1, PLAIN[0]), (1, PLAIN[0]), (2, None), (3, ""), (4, PLAIN[1]), (4, PLAIN[0] + " Twice."), (None, PLAIN[1]), (5, PLAIN[1] * 400), (6, "\t \n")]


@pytest.mark.parametrize("k", range(5))
def test_odd_rows_and_empty_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = frame(spark, ODD)
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert {r.doc_id for r in rows} <= {d for d, _ in ODD}
    if k < 4:
        assert got.schema.names == docs.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert all((r.lang, r.source, r.component_id, r.row, r.key) == ("en", "web", 3, "r", 5) for r in rows), name
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_scoring_stages_judge_each_row_by_its_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        kept = {r.doc_id for r in stage(spark, docs, SF).collect()}
        twice = stage(spark, docs.union(docs), SF).groupBy("doc_id").count().collect()
        assert kept and {r.doc_id for r in twice} == kept and {r["count"] for r in twice} == {2}


def test_one_of_each_group_stays(spark):
    words = [f"w{i}" for i in range(60)]
    near = words[:58] + ["x", "y"]
    rows = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(words).upper()), (4, " ".join(f"u{i}" for i in range(60))), (5, None), (6, ""), (3, " ".join(near))]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), SF).collect()
    assert sorted(r.doc_id for r in got) == [3, 3, 4, 5, 6]


def test_texts_change_with_their_length(spark):
    passage = "".join(chr(97 + i * 7 % 26) for i in range(120))
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.without_repeats(spark, frame(spark, [(1, passage + " one"), (2, "two " + passage), (3, passage), (4, None), (5, "")]), SF).collect()}
    assert got == {1: (passage + " one", 124), 2: ("two ", 4), 4: (None, None), 5: ("", 0)}


def test_packing_takes_all_that_is_left(spark):
    got = corpus_pipeline.packed(spark, frame(spark, ODD), SF).collect()
    tokens = {(r.doc_id, r.start): r.length for r in got}
    assert {d for d, _ in tokens} == {1, 2, 3, 4, 5, 6} and all(0 < r.length <= 1024 and r.offset + r.length <= 1024 for r in got)
