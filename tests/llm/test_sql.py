"""Each operator against its SQL: on the planted rows of the other tests, with fuzzed personal data, and on the smallest tables."""

import random

import duckdb
import pandas as pd
import pytest

from test_ops import corpus
from typedframe.llm import near_dedup, pii, queries, secret_scan, substring_dedup, suffix_dedup

DIR = "/root/testdata/sf0.001"


def fuzzed() -> list[str]:
    r = random.Random(8)
    parts = ["IBAN ", "IBAN:", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "SSN: ", "SSN#", "078-05-1120", "://", "me:pw@", "a.b", "@x.org", "4111 1111 1111 1111", "4111111111111112", "+1 555 010 9999", "1.2.3.4", "256.1.1.1", "X", "-", " ", "é", "7"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(1500)]


def rows_of(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def texts():
    return pd.DataFrame([(k, t, (None, "en", "de")[k % 3], (None, "s1", "s2", "s3")[k % 4], len(t or "")) for k, t in enumerate([t for _, t in corpus()] + fuzzed())], columns=["doc_id", "text", "lang", "source", "n_chars"])


@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op4_near_dedup", "op8_substring_dedup", "op9_pii", "op10_secrets"])
def test_planted(spark, texts, name):
    run = {"op1_suffix_dedup": suffix_dedup.suffix_dedup, "op4_near_dedup": lambda d: near_dedup.near_dedup(d, percent=85), "op8_substring_dedup": substring_dedup.substring_dedup, "op9_pii": pii.pii_spans, "op10_secrets": secret_scan.secret_scan}[name]
    con = duckdb.connect()
    con.register("documents", texts)
    docs = spark.createDataFrame(list(texts.astype(object).where(texts.notna(), None).itertuples(index=False, name=None)), "doc_id long, text string, lang string, source string, n_chars long")
    got, want = run(docs).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)
    if name == "op9_pii":
        assert {s.split(":")[0] for x in got.spans for s in x.split(",") if s} == set(pii.KINDS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_tables(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    assert rows_of(queries.queries()[name](spark, DIR).toPandas()) == rows_of(con.execute(queries.oracle_sql()[name]).df())
