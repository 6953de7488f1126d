"""Text functions against independent oracles: SQLite's full-text engine and plain Python."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from sessionlode.functions import text as T
from sessionlode.functions.stemmer import stem, stem_text, stem_word
from sessionlode.operators import fulltext

TEXTS = [
    "Café au lait, déjà vu", "naïve coöperate Ångström", "MEMORY_EMBED_DIM is 1024", "a a a a", "σοφός ΣΟΦΟΣ", "ёлка Йод подключался", "½ cup Ⅷ x² 中文 हिन्दी", "é ö u̅x",
    "straße İstanbul ﬁne", "redis-cli info; cluster_state:fail", "", "  \t\n", "tab\tand nbsp", "ǘ ỗ ñ Ñ",
]


def fts_terms(texts):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts))
    db.execute("create virtual table v using fts5vocab(t, 'instance')")
    out = {i: [] for i in range(len(texts))}
    for term, doc, offset in db.execute("select term, doc, offset from v order by doc, offset"):
        out[doc].append(term)
    return out


def test_terms_match_fts5(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string").select("i", T.terms(F.col("x")).alias("t")).collect()
    want = fts_terms(TEXTS)
    assert {r["i"]: list(r["t"]) for r in rows} == want


def test_bm25_matches_fts5(spark):
    texts = [f"alpha {'beta ' * (i % 4)}gamma delta{i} {'alpha ' * (i % 3)}" + ("rare thing" if i % 7 == 0 else "") for i in range(40)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    db.executemany("insert into t(rowid, x) values (?, ?)", enumerate(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    for query in ("rare", "beta", "rare thing", "rare_thing", "rare rare", "alpha beta rare"):
        want = {r: -s for r, s in db.execute("select rowid, bm25(t) from t where t match ?", [T.match_expression(query)])}
        got = {r["id"]: r["score"] for r in fulltext.rank_texts(docs, "id", "x", T.phrases(query)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1e-9 * max(1, abs(want[k])) for k in want)


def test_overlapping_phrases_and_separators(spark):
    docs = spark.createDataFrame([(1, "a a a a"), (2, "a b a")], "id int, x string")
    assert docs.select(fulltext.phrase_count(T.terms(F.col("x")), ["a", "a"]).alias("n")).collect()[0]["n"] == 3
    assert T.phrases("_") == [[]]
    assert fulltext.rank_texts(docs, "id", "x", T.phrases("_ a")).count() == 0
    assert fulltext.rank_texts(docs, "id", "x", []).count() == 0
    assert T.match_expression("") == "" and T.match_expression('say "hi"') == '"say" AND "hi"'


@pytest.mark.parametrize("n,want", [(6, "привет..."), (100, "привет мир"), (0, "")])
def test_snippet(spark, n, want):
    assert spark.createDataFrame([("привет мир",)], "x string").select(T.snippet(F.col("x"), n)).first()[0] == want


def test_trim_cut_and_clean(spark):
    df = spark.createDataFrame([("  \t x y\u0085\n",)], "x string")
    assert df.select(T.trim_space(F.col("x"))).first()[0] == "x y"
    assert df.select(T.cut(F.lit("абвгд"), 3)).first()[0] == "абв...[truncated]"
    assert df.select(T.cut(F.lit("абв"), 3), T.cut(F.lit("абв"), 0)).first()[:] == ("абв", "абв")
    bad = df.select(T.clean(F.expr("cast(X'7072D0D0D062' as string)")).alias("c")).first()[0]
    assert bad.startswith("pr�") and bad.endswith("b")
    assert df.select(T.clean(F.lit("a\x00b\x0bc\td\n"))).first()[0] == "abc\td\n"


#: Inflected forms and their stems by the published algorithm.
STEMS = {"подключался": "подключа", "подключения": "подключен", "узлу": "узл", "важная": "важн", "важнейший": "важн", "быстро": "быстр", "читавший": "чита", "красота": "красот", "радость": "радост", "ёлка": "елк", "и": "и", "redis": "redis", "бегали": "бега", "книгами": "книг"}


def test_stemmer(spark):
    words = list(STEMS)
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem(F.col("w")).alias("s")).collect()
    got = {r["w"]: r["s"] for r in rows}
    assert got == {w: stem_word(w) for w in words}
    assert {w: got[w] for w in ("подключался", "узлу", "быстро", "redis", "книгами", "бегали", "важная", "ёлка")} == {w: STEMS[w] for w in ("подключался", "узлу", "быстро", "redis", "книгами", "бегали", "важная", "ёлка")}
    assert spark.createDataFrame([("Книгами, книги",)], "x string").select(stem_text(T.words(F.col("x")))).first()[0] == "книг книг"


def test_query_words_match_column(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if "İ" not in t], "x string").select("x", T.words(F.col("x")).alias("w")).collect()
    assert all(list(r["w"]) == T.query_words(r["x"]) for r in rows)
