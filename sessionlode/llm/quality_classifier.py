"""Quality by hierarchical empirical Bayes.

1. Evidence: a logistic classifier over the words of a text and eight shares gives each document a probability. Words count
   by naive Bayes over hashed words, learned in two halves, so that the classifier is fitted to scores of documents that the
   words were not learned from. Both are fitted on at most ``max_labelled`` labelled documents, those with the least hash of
   their id; nothing else is bounded.
2. Sites: the probabilities (labels, where there are any, count as certain) are summed by host and by path. A host's
   posterior shrinks to the global mean, a path's to its host's; how strongly is itself estimated from the spread between
   groups (method of moments), so sparse sites stay near their prior and large ones speak for themselves.
3. Verdict: the log odds of a document's own evidence plus what its site says beyond the global mean. A site's sums leave
   the document's own evidence out.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlode.llm.scratch import Scratch

MAX_LABELLED = 50_000
RIDGE = 1.0
STEPS = 25
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6
CLIP = 1e-4
KEEP = 0.5
WHITE = r"[\t-\r ]+"
#: Slots of hashed words, and the weight of the prior in each.
SLOTS, SMOOTH = 1 << 14, 1.0
#: Sums of sites are broadcast up to this many bytes; beyond that rows and sums meet by site and salt.
MOST_BROADCAST, SALTS = 32 << 20, 16


def features(text: Column) -> list[Column]:
    """Native features of a text, all of them shares or logarithms. A null or empty text has none but the constants."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WHITE), "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(text), F.lit(1)).cast("double")
    lost = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    return [
        F.least(lost(r"[#*$%&|<>~^=]+") / n, F.lit(4.0)),
        F.least(lost(r"!+") / n, F.lit(4.0)),
        lost(r"\p{Lu}+") / chars,
        lost(r"[0-9]+") / chars,
        F.size(F.array_distinct(words)) / n,
        F.least(lost(r"[.?;:,]+") / n, F.lit(2.0)),
        F.log1p(n),
        F.least(chars / n, F.lit(30.0)) / 10,
    ]


def slots(text: Column) -> Column:
    """The distinct slots of a text's words, A-Z in lower case."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WHITE), "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))


def word_weights(counts: list[tuple[int, float, float]]) -> list[float]:
    """Log odds of each slot from (slot, good documents, bad documents) that have it."""
    table = np.full((SLOTS, 2), SMOOTH)
    for at, good, bad in counts:
        table[at] += good, bad
    share = table / table.sum(axis=0)
    return [round(float(x), 6) for x in np.log(share[:, 0] / share[:, 1])]


def _word_score(found: Column, weights: list[float]) -> Column:
    """The mean weight of the slots of a text; 0 for none."""
    table = F.from_json(F.lit(json.dumps(weights)), "array<double>")  # folded to one literal of SLOTS doubles
    total = F.aggregate(found, F.lit(0.0), lambda a, x: a + F.get(table, x))
    return total / F.greatest(F.size(found), F.lit(1))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; weights with the constant last. No rows, or one class: the prior."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(STEPS if len(set(y)) > 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.full(len(w), RIDGE)
        penalty[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def strength(groups: DataFrame, mean: Column, n: str = "n", s: str = "s") -> Column:
    """Aggregate: pseudo-counts of the prior, by the method of moments, for groups with n and sum s around their mean. A single
    group, or groups that differ no more than their documents do, shrink all the way."""
    m = F.col(s) / F.col(n)
    total, squares = F.sum(n).cast("double"), F.sum(F.col(n) * F.col(n)).cast("double")
    within = F.try_divide(F.sum(F.col(n) * mean * (1 - mean)), total)
    between = F.try_divide(F.sum(F.col(n) * (m - mean) * (m - mean)) - (F.count("*") - 1) * within, total - F.try_divide(squares, total))
    k = F.try_divide(within, between) - 1
    return F.coalesce(F.when(between > 0, F.greatest(F.lit(LEAST_STRENGTH), F.least(k, F.lit(MOST_STRENGTH)))), F.lit(MOST_STRENGTH))


def _clip(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(p, F.lit(1 - CLIP)))


def _logit(p: Column) -> Column:
    return F.log(_clip(p) / (1 - _clip(p)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: Column | str = "source", path: Column | str = "lang", label: str = "quality", max_labelled: int = MAX_LABELLED, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, evidence, host_posterior, path_posterior, score (all doubles from 0 to 1) and
    kept (score >= ``keep``). ``labels`` has doc_id and a 0/1 column.

    ``host`` and ``path`` are columns or expressions over ``docs``; null ones form a site of their own. Labels of a repeated
    doc_id are averaged, null ones ignored; rows without a doc_id are classified without a label. Without any labels all
    evidence is 0.5. Null and empty texts are classified by their (constant) features, whole texts by all their words,
    however many. Repeated rows are judged alike and count each in their site. An empty table gives an empty result. Other
    columns, whatever their names, are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    column = lambda c: F.col(f"`{c}`") if isinstance(c, str) else c
    site = F.coalesce(column(host).cast("string"), F.lit("")), F.coalesce(column(path).cast("string"), F.lit(""))
    known = labels.where(F.col(f"`{label}`").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col(f"`{label}`").cast("double")).alias("y"))
    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("k"), F.round("y").alias("label"), half.alias("half"))
    chosen = scratch.table(chosen, "chosen")
    texts = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("k"))  # max_labelled rows
    words = texts.select("label", "half", F.explode(slots(F.col("text"))).alias("slot")).groupBy("half", "slot").agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).collect()  # 2 * SLOTS rows
    weights = [word_weights([(r["slot"], r["good"], r["bad"]) for r in words if r["half"] == h]) for h in (0, 1)]

    plain = docs.select(column(doc_id).alias("doc_id"), site[0].alias("host"), site[1].alias("path"), column(text).alias("text"))
    found = plain.withColumn("slots", slots(F.col("text")))
    rows = found.select("doc_id", "host", "path", F.array(*features(F.col("text"))).alias("x"), *[_word_score(F.col("slots"), w).alias(f"w{h}") for h, w in enumerate(weights)])
    rows = scratch.table(rows.join(known, "doc_id", "left"), "rows", wide=True)

    # Words of one half score the documents of the other.
    sample = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select(F.concat("x", F.array(F.when(F.col("half") == 0, F.col("w1")).otherwise(F.col("w0")))).alias("x"), "label").collect()  # max_labelled rows
    beta = fit(np.array([r["x"] for r in sample]), np.array([r["label"] for r in sample])) if sample else np.zeros(10)
    odds = F.lit(float(beta[-1])) + (F.col("w0") + F.col("w1")) / 2 * float(beta[-2])
    for k, w in enumerate(beta[:-2]):
        odds = odds + F.get("x", k) * float(w)
    rows = rows.select("doc_id", "host", "path", _clip(1 / (1 + F.exp(-odds))).alias("evidence"), "y").withColumn("e", F.coalesce("y", "evidence"))

    paths = scratch.table(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    top = hosts.agg((F.sum("s") / F.sum("n")).alias("mean")).first()["mean"] or 0.5
    mean = F.lit(float(min(max(top, CLIP), 1 - CLIP)))
    k_host = float(hosts.agg(strength(hosts, mean).alias("k")).first()["k"])
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.col("s") + mean * k_host) / (F.col("n") + k_host)).alias("host_posterior"))
    paths = scratch.table(paths.join(hosts, "host"), "sites")
    k_path = float(paths.agg(strength(paths, _clip(F.col("host_posterior"))).alias("k")).first()["k"])
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    if size <= MOST_BROADCAST:
        full = rows.join(F.broadcast(paths), ["host", "path"])
    else:  # a large site meets its sums in as many tasks as there are salts
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        full = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(SALTS)).cast("int")).join(salted, ["host", "path", "salt"])
    own_host = (F.col("host_s") - F.col("e") + mean * k_host) / (F.col("host_n") - 1 + k_host)
    own_path = (F.col("s") - F.col("e") + own_host * k_path) / (F.col("n") - 1 + k_path)
    total = _logit(F.col("evidence")) + _logit(own_path) - _logit(mean)
    full = full.withColumn("score", 1 / (1 + F.exp(-total)))
    path_posterior = (F.col("s") + F.col("host_posterior") * k_path) / (F.col("n") + k_path)
    return full.select("doc_id", "evidence", "host_posterior", path_posterior.alias("path_posterior"), "score", (F.col("score") >= keep).alias("kept"))


def url_site(url: Column) -> tuple[Column, Column]:
    """Host and first path segment of a URL, for pages; null where it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST"))), F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^/[^/]*", 0)
