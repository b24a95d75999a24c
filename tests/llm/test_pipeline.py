"""The pipeline's stages keep columns, judge every row by itself, and their decisions take effect."""

import random

import corpus_pipeline
from typedframe.llm import pii

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def prose(seed: int, n: int = 80) -> str:
    """English words in an order of its own."""
    words = "the people of this house and their water are free to think about every other place where great things might begin again with us in time for all who live here".split()
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice(("", "", ",", ".")) for _ in range(n))


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{DIR}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DIR).cache()
        assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] == seen[-2] < 200
    assert all(len(r.text) == r.n_chars and not [s for s in pii.find(r.text) if s[0] == "email"] for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert pieces.select("doc_id").distinct().count() == seen[-1]
    assert pieces.count() == corpus_pipeline.run(spark, DIR).count()


def stage_ids(spark, name, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.text) for r in STAGE[name](spark, df, DIR).collect()), key=repr)


def test_exact_stage_keeps_one_row_of_each_text(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (1, a), (None, b), (7, b), (None, c), (None, c), (None, a + " x"), (5, ""), (6, None), (8, " ")]
    assert stage_ids(spark, "exact_dedup", rows) == sorted([(1, a), (7, b), (None, c), (None, a + " x"), (5, ""), (8, " ")], key=repr)


def test_exact_stage_compares_texts_where_hashes_collide(spark):
    from pyspark.sql import functions as F
    from typedframe.llm import exact_dedup

    a, b = prose(1), prose(2)
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in enumerate((a, b, a, None, b, a))] + [(0, a, "en", "s", 1)], SCHEMA)
    out = exact_dedup.first_rows(df, hashed_by=lambda c: F.lit("00")).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(0, a), (1, b), (3, "")]


def test_near_stage_judges_rows_of_one_id_and_of_none(spark):
    a, b, c = (prose(k, 200) for k in (1, 2, 3))
    rows = [(4, a), (None, a + " more"), (None, b), (None, b + " more"), (9, c), (None, None), (2, "")]
    out = stage_ids(spark, "near_dedup", rows)
    assert (4, a) in out and (9, c) in out and (2, "") in out and (None, None) in out
    assert len(out) == 5 and sum(t in (b, b + " more") for _, t in out) == 1


def test_quality_stage_judges_rows_by_themselves(spark):
    a = prose(1, 120)
    rows = [(1, a), (1, "too short"), (None, a), (None, "word " * 100), (None, None)]
    assert stage_ids(spark, "quality", rows) == sorted([(1, a), (None, a)], key=repr)


def test_redaction_and_packing_take_nulls(spark):
    rows = [(None, None), (1, ""), (2, "mail a@b.co now")]
    assert stage_ids(spark, "pii", rows) == sorted([(None, None), (1, ""), (2, "mail <email> now")], key=repr)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    lengths = {r.doc_id: r.length for r in STAGE["packing"](spark, df, DIR).collect()}
    assert lengths[None] == lengths[1] == 1 < lengths.pop(2) and len(lengths) == 2


def test_stages_take_empty_tables_and_more_columns(spark):
    empty = spark.createDataFrame([], SCHEMA + ", kept string, h string, cls string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0
