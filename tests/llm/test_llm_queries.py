"""Queries against their SQL, over whole tables; for the two without SQL, the tokenizer's library and held-out accuracy."""

import pytest

from tests.oracle import DATA, assert_same
from tidemark.llm import queries

SQL = queries.oracle_sql()
QUERIES = queries.queries()


@pytest.mark.parametrize("name", SQL)
def test_query_gives_what_its_sql_gives(spark, name):
    assert_same(QUERIES[name](spark, DATA), SQL[name])


def test_tokens_are_those_of_the_library(spark):
    import hashlib

    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op7_sentencepiece"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = model.encode(docs[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_classifier_on_held_out_labels(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    rows = QUERIES["op9_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) >= 0.8 * len(bad)
