"""Queries of the engine on tables that differ from the test tables, against their SQL."""

import duckdb
import pytest

from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.operators import fulltext
from sessionlode.plans import catalog, engine_queries
from sessionlode.plans.index import POSTINGS


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Conversation 7 begins with the system, so its tool part is not in turn 1."""
    path = str(tmp_path_factory.mktemp("tables"))
    roles = ["system", "user", "assistant", "user", "assistant", "user"]
    data = [(c, t, roles[(t + c - 7) % 6] if c >= 7 else roles[t], f"From {c} with {t} words, with the rest") for c in range(12) for t in range(6)]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def check(spark, sf, name):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{sf}/conversations.parquet/*.parquet'")
    want = c.sql(catalog.SQL[name])
    columns = sorted(want.columns)
    plain = lambda found: sorted(repr(tuple(r)) for r in found)
    assert plain(catalog.Q[name](spark, sf).select(*columns).collect()) == plain(want.select(*columns).fetchall())


def test_lookups_find_a_tool_part_in_any_turn(spark, sf):
    check(spark, sf, "history_lookups")


@pytest.mark.parametrize("name", ["cli_sessions", "cli_session", "tool_read", "tool_context", "tool_session"])
def test_listings_and_reads_build_no_index(spark, sf, monkeypatch, name):
    def refuse(*_):
        raise AssertionError("an index was built")

    monkeypatch.setattr(engine_queries, "built", refuse)
    check(spark, sf, name)


def test_needs_take_one_run(spark, sf, monkeypatch):
    def refuse(*_):
        raise AssertionError("a second run")

    monkeypatch.setattr(engine_queries, "upkept", refuse)
    check(spark, sf, "index_needs")


def test_cache_takes_two_runs(spark, sf, monkeypatch):
    runs, run = [], engine_queries.Index.run
    monkeypatch.setattr(engine_queries.Index, "run", lambda *a, **k: runs.append(1) or run(*a, **k))
    check(spark, sf, "embedding_cache")
    assert len(runs) == 2


@pytest.mark.parametrize("name", ["index_replaced", "index_upkeep", "index_backfill"])
def test_upkeep_on_other_tables(spark, sf, name):
    check(spark, sf, name)


def test_listed_groups_as_postings_do(spark):
    texts = [("a", "b a b  é x"), ("b", ""), ("c", None), ("d", "a " * 600), ("e", "b")]
    rows = spark.createDataFrame(texts, "id string, text string").repartition(1)
    want = fulltext.postings(rows, "text").collect()
    tokens = rows.select("id", T.terms(F.col("text")).alias("tokens"))
    for batch in (1, 2, 512):
        got = fulltext.listed(tokens, "tokens", batch).collect()
        assert sorted((r["term"], r["id"], r["positions"]) for r in got) == sorted((r["term"], r["id"], r["positions"]) for r in want)
        assert {r["id"]: r["length"] for r in got} == {"a": 5, "d": 600, "e": 1}


def test_posting_files_hold_one_source_in_order(spark, sf):
    index, seen = engine_queries.built(spark, sf)[1], []
    for path in index.postings("fts_unicode").inputFiles():
        rows = spark.read.parquet(path).select("source", "term").collect()
        assert len({r["source"] for r in rows}) <= 1
        assert [r["term"] for r in rows] == sorted(r["term"] for r in rows)
        seen += rows
    assert {r["source"] for r in seen} == set(POSTINGS)
