"""Quality rules, line first: judge each line, take failing lines out, then reject documents that lose too much.

Native: one narrow pass of SQL functions over arrays, without a shuffle or Python. Repeated five-word windows are told by
64-bit hashes within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[\t-\r ]"
WORD = r"[^\t-\r ]"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
#: A mark that ends a sentence: before white space or the end of the line, closing quotes and brackets aside; marks of scripts
#: that put no space after a sentence count anywhere. A mark inside a word or a URL ends nothing.
SENTENCE_END = r"""[.!?…؟۔։።៕]['"”’»)\]]*(?:[\t-\r ]|\z)|[。！？｡।॥။།]"""
#: Thai and Lao have no such marks, so their lines need none.
UNMARKED = r"[\x{0E01}-\x{0E2E}\x{0E81}-\x{0EAE}]"
BANG = r"!(?:[\t-\r ]|\z)"
#: A line without these needs no counts.
COUNTED = r"[#*$%&|<>»›•·!]"
#: Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "released under the",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for",
    "subscribe to our",
    "skip to content",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "verwendung von cookies",
    "tous droits réservés",
    "politique de confidentialité",
    "utilisation de cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "uso de cookies",
)
#: A line fails if symbols or separators number a fifth of its words, or every second word of four or more ends in "!".
SYMBOL_SHARE, BANG_SHARE, BANG_WORDS = 5, 2, 4
#: A document is rejected if less than this part of its characters (white space aside) is left: 1 / LEAST_LEFT.
LEAST_LEFT = 2
LEAST_WORDS, REPEAT_SHARE, WINDOW = 10, 20, 5


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_passes(line: Column, phrases: Column, counted: Column) -> Column:
    """The verdict on one line; ``phrases`` and ``counted``: whether its text holds a boilerplate phrase, or a sign that is
    counted, at all. A line without words passes: there is nothing to take out."""
    words, symbols, separators, bangs = (_count(line, x) for x in (WORD + "+", SYMBOLS, SEPARATORS, BANG))
    noisy = (symbols * SYMBOL_SHARE >= words) & (symbols > 0) | (separators * SYMBOL_SHARE >= words) & (separators > 0) | (words >= BANG_WORDS) & (bangs * BANG_SHARE >= words)
    spoken = F.endswith(line, F.lit(".")) | line.rlike(SENTENCE_END) | line.rlike(UNMARKED)  # the first settles most lines
    boilerplate = F.when(phrases, _holds(F.lower(line))).otherwise(False)
    return (spoken & ~boilerplate & ~F.when(counted & line.rlike(COUNTED), noisy).otherwise(False)) | ~line.rlike(WORD)


def _holds(text: Column) -> Column:
    """Whether a lower-case text holds a phrase."""
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | F.contains(text, F.lit(phrase))
    return out


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` (it replaces one of that name); see ``judge`` for its fields.

    Null and empty texts have no words: all counts are 0, base_failed is true, kept is false. Whole texts are judged, however
    long. Repeated rows are judged alike, an empty table stays empty. Other columns pass through.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn("quality", F.struct(F.array_remove(F.split(whole, WHITE + "+"), "").alias("words"), F.split(whole, "\n").alias("all_lines"), _holds(F.lower(whole)).alias("phrases"), whole.rlike(COUNTED).alias("counted"), _count(whole, SYMBOLS).cast("long").alias("symbols")))
    q = lambda name: F.col(f"quality.{name}")
    hashes = F.transform(q("words"), lambda w: F.xxhash64(w))
    out = out.withColumn(
        "quality",
        F.struct(
            F.size(q("words")).cast("long").alias("n_words"),
            F.length(F.array_join(q("words"), "")).cast("long").alias("word_chars"),
            q("symbols").alias("symbols"),
            F.filter(q("all_lines"), lambda x: x.rlike(WORD)).alias("lines"),
            F.filter(q("all_lines"), lambda x: line_passes(x, q("phrases"), q("counted"))).alias("kept_lines"),
            F.size(q("all_lines")).alias("n_lines"),
            hashes.alias("hashes"),
        ),
    )
    hashes = q("hashes")
    held = [q(x).alias(x) for x in ("n_words", "word_chars", "symbols", "lines", "kept_lines", "n_lines")]
    windows = F.transform(F.slice(hashes, 1, F.greatest(q("n_words") - (WINDOW - 1), F.lit(0)).cast("int")), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))
    out = out.withColumn("quality", F.struct(*held, windows.alias("windows")))
    ordered = F.when(F.size(F.array_distinct(q("windows"))) < F.size(q("windows")), F.sort_array(F.transform(q("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumn("quality", F.struct(*held, ordered.alias("ordered")))
    ordered = q("ordered")
    twice = F.filter(F.transform(ordered, lambda x, k: F.when((x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"]), x["i"])), lambda x: x.isNotNull())
    out = out.withColumn("quality", F.struct(*held, F.sort_array(twice).alias("twice")))
    twice = q("twice")
    covered = F.aggregate(F.transform(twice, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(twice, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    kept_text = F.array_join(q("kept_lines"), "\n")
    counted = F.struct(
        q("n_words").alias("n_words"),
        q("word_chars").alias("word_chars"),
        q("symbols").alias("n_symbols"),
        (F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (q("n_lines") - F.size(q("kept_lines"))).cast("long").alias("n_lines_removed"),
        F.when(F.size(q("kept_lines")) == q("n_lines"), q("word_chars")).otherwise(F.length(F.regexp_replace(kept_text, WHITE + "+", "")).cast("long")).alias("left_chars"),
        kept_text.alias("text"),
    )
    # A generator of one row, so that filters on the outcome stay above it and nothing is computed twice.
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"], F.explode(F.array(counted)).alias("quality"))
    failed = (q("n_words") < LEAST_WORDS) | (q("n_repeat_words") * 100 > q("n_words") * REPEAT_SHARE)
    kept = ~failed & (q("left_chars") * LEAST_LEFT >= q("word_chars"))
    return out.withColumn("quality", F.col("quality").withField("base_failed", failed).withField("kept", kept))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_removed, left_chars."""
    rows = measure(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "left_chars")
    return rows.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in fields])


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with failing lines taken out of ``text``; the columns stay as they are."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = measure(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names[text])
    return rows.where("quality.kept").select(*[(F.col("quality.text") if c == text else F.col(n)).alias(c) for c, n in names.items()])


_PHRASES, _END = "|".join(BOILERPLATE), SENTENCE_END.replace("'", "''")
#: The same in DuckDB's SQL.
SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS p
  FROM (SELECT r, list_filter(regexp_split_to_array(text, '[\t-\r ]+'), lambda x: x <> '') AS w FROM docs)),
windows AS (
  SELECT r, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY r ORDER BY p)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY r),
counted AS (SELECT r, count(*) AS n, sum(length(w)) AS chars, sum(length(w) - length(regexp_replace(w, '[#*$%&|<>]', '', 'g'))) AS symbols FROM words GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
judged AS (
  SELECT r, l, regexp_matches(l, '[^\t-\r ]') AS full_line, len(regexp_extract_all(l, '[^\t-\r ]+')) AS n,
    len(regexp_extract_all(l, '[#*$%&|<>]')) AS s, len(regexp_extract_all(l, '{SEPARATORS}')) AS seps, len(regexp_extract_all(l, '{BANG}')) AS bangs
  FROM lines),
passed AS (
  SELECT *, NOT full_line OR NOT (NOT regexp_matches(l, '{_END}') AND NOT regexp_matches(l, '{UNMARKED}') OR s > 0 AND s * {SYMBOL_SHARE} >= n OR seps > 0 AND seps * {SYMBOL_SHARE} >= n
    OR n >= {BANG_WORDS} AND bangs * {BANG_SHARE} >= n OR regexp_matches(lower(l), '{_PHRASES}')) AS ok
  FROM judged),
by_line AS (
  SELECT r, count(*) FILTER (full_line) - count(DISTINCT l) FILTER (full_line) AS dup, count(*) FILTER (NOT ok) AS removed,
    coalesce(sum(length(regexp_replace(l, '[\t-\r ]+', '', 'g'))) FILTER (ok), 0) AS left_chars
  FROM passed GROUP BY r),
joined AS (
  SELECT doc_id, coalesce(c.n, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars, coalesce(symbols, 0)::BIGINT AS n_symbols,
    dup::BIGINT AS n_dup_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words, removed::BIGINT AS n_lines_removed, left_chars::BIGINT AS left_chars
  FROM docs LEFT JOIN counted c USING (r) LEFT JOIN covered v USING (r) LEFT JOIN by_line USING (r)),
based AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_SHARE} * n_words AS base_failed FROM joined)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND left_chars * {LEAST_LEFT} >= word_chars AS kept, n_lines_removed, left_chars
FROM based
"""
