"""Texts of many megabytes through every operator on texts."""

import random

import pytest
from pyspark.sql import functions as F

from sessionlode.llm import bpe, language_id, line_dedup, ngram_join, pii, quality_classifier, quality_rules, token_counts
from sessionlode.llm.queries import tokenizer_path

LINES = 110_000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(20_000)]
    lines = [" ".join(rng.choices(vocab, k=13)) + "." for _ in range(LINES)]
    other = list(lines)
    other[LINES // 2] = "another line stands here now, and it says quite different things than before, does it not."
    return ["\n".join(lines), "\n".join(other) + "\nwrite to someone@example.org today.", "A short text of a few words stands here as well, with an end."]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    assert len(texts[0]) > 8_000_000
    path = str(tmp_path_factory.mktemp("long") / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("aa"), "source": F.lit("s")}).write.parquet(path)
    return spark.read.parquet(path)


def test_rules_and_counts(docs, texts):
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert [got[d]["n_words"] for d in range(3)] == [len(t.split()) for t in texts]
    assert [got[d]["word_chars"] for d in range(3)] == [sum(map(len, t.split())) for t in texts]
    assert all(got[d]["kept"] and got[d]["n_lines_removed"] == 0 for d in range(3))


def test_tokens(docs, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = {r["doc_id"]: r["n_tokens"] for r in bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path()).collect()}
    assert [got[d] for d in range(3)] == want
    top = token_counts.summary(token_counts.histogram(docs, tokenizer_path())).orderBy(F.desc("n_tokens")).first()
    assert (top["n_tokens"], top["truncated_tokens"]) == (max(want), sum(want))


def test_links_and_lines(docs):
    got = {r["doc_id"]: (r["n_shingles"] > 1_000_000, r["component_id"]) for r in ngram_join.link(docs).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 2)}
    lines = {r["doc_id"]: r for r in line_dedup.report(docs).collect()}
    assert lines[0]["n_removed"] == 0 and lines[1]["n_removed"] == LINES - 1 and LINES // 2 not in lines[1]["removed"]


def test_personal_data_language_and_quality(spark, docs, texts):
    found = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["found"]] for r in pii.detect(docs).collect()}
    assert found[1] == [("email", texts[1].index("someone@"))] and found[0] == found[2] == []
    more = spark.createDataFrame([(100 + i, "schön über Straße und Fluß " * 9, "bb", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    named = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs.select(*more.columns).unionByName(more)).collect()}
    assert [named[d] for d in (0, 1)] == ["aa", "aa"] and named[100] == "bb"
    labels = spark.createDataFrame([(0, 1), (2, 0)], "doc_id long, quality int")
    assert quality_classifier.classify(docs, labels).count() == 3
