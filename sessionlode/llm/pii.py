"""Personal data by weak supervision.

Base spans (e-mail, IP address, payment card, phone) follow fixed patterns and always stay. For further kinds, patterns
only propose candidates; labelers vote on each of them:

- pattern: the strict form of the kind (votes for), or a form that such spans do not have (against);
- gazetteer: known prefixes and given names (for), or placeholder values (against);
- context: words before the span that announce the kind (for), or something else (against).

Expectation-maximisation estimates for each kind how reliable each labeler is, from counts of vote patterns alone, and so
the probability that a candidate is personal. These probabilities are soft labels for the final classifier, naive Bayes
over the votes and features of the span that no labeler sees: length, share of digits, classes of characters, the signs on
either side, and how varied its characters are. What it accepts is added to the spans, whatever the single votes were.

Native: SQL functions over arrays find, vote and accept; one grouped count feeds the estimation. Votes and features take a
few values each, so the counted table has a fixed bound (``MOST_PATTERNS`` a kind), whatever the size of the corpus; only that
reaches the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionlode.llm.scratch import Scratch

#: The base patterns, in forms that scan in linear time and match the same (runs are taken whole, and a match
#: starts where its run starts or the last match ended).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these has no match.
NEEDS = {"email": "@", "ip": r"\.", "card": "[0-9]", "phone": r"\+", "ssn": "[0-9]", "tel": "[0-9]"}
#: Candidates of further kinds.
PROPOSED = {
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.? \p{Lu}[\p{L}'’-]++(?: \p{Lu}[\p{L}'’-]++)?",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+.() -])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
}
KINDS = (*BASE, *PROPOSED)
#: Code points before a span in which words may announce it.
CONTEXT_CHARS = 32
#: Values of votes and features of one kind: 3 votes of 3, length 4, digits 4, classes 8, signs before 5 and after 4, variety 3.
MOST_PATTERNS = 3**3 * 4 * 4 * 8 * 5 * 4 * 3
#: Words before a span that announce its kind, and words that announce something else.
ANNOUNCE = {
    "name": r"(?:name|contact|from|signed|author|patient|dear|by)\P{L}*$",
    "secret": r"(?:pass(?:word|wd)?|pwd|token|secret|key|bearer|credentials?|auth)[\"']?\s*[:=]?\s*[\"']?$",
    "ssn": r"(?:ssn|social|security|tax|insurance)\P{L}*(?:no|number|nr)?\P{L}*$",
    "tel": r"(?:tel|telephone|phone|call|fax|mobile|cell)\P{L}*$",
}
DENY = {
    "name": r"(?:company|brand|street|product)\P{L}*$",
    "secret": r"(?:sha1|sha256|md5|commit|checksum|revision|isbn|href|src|https?:|/)\P{L}*$",
    "ssn": r"(?:order|part|model|invoice|version)\P{L}*$",
    "tel": r"(?:order|part|model|invoice|version|isbn)\P{L}*$",
}
STRICT = {
    "name": r"^\p{L}+\. \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
    "secret": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,64}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{32,})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "tel": r"^\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}$",
}
LOOSE = {
    "name": r"\b(?:The|And|Of|In|A)$",
    "secret": r"^(?:\p{L}+|[0-9]+|[-_/+]+|[\p{L}/_-]+)$",
    "ssn": r"^(?:000|666|9)",
    "tel": r"^\(?[01]",
}
KNOWN = {
    "name": (
        r"(?i) (?:ahmed|alexander|ali|ana|andrea|andrew|anna|antonio|carlos|carmen|charles|chen|christine|claire|daniel|david|elena|elizabeth|emma|eva|fatima|francois|george|giulia|hans|ivan|"
        r"james|jan|jean|jennifer|johann|john|jose|juan|julia|karen|karl|kim|laura|lee|linda|luis|manuel|maria|marie|mark|martin|mary|michael|mohammed|nina|olga|patricia|paul|peter|pierre|"
        r"priya|richard|robert|sara|sarah|sofia|sophie|stefan|susan|thomas|wang|wei|william|yuki)\b"
    ),
    "secret": r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|ya29|eyJ)",
    "ssn": r"^(?:[0-6][0-9]{2}|7[0-6][0-9])-",
    "tel": r"^\(?(?:2(?:0[1-9]|1[0-9])|3(?:0[1-9]|1[0-9])|4(?:0[1-9]|1[0-9])|5(?:0[1-9]|1[0-9])|6(?:0[1-9]|1[0-9])|7(?:0[1-9]|1[0-9])|8(?:0[1-9]|1[0-9])|9(?:0[1-9]|1[0-9]))",
}
PLACEHOLDER = {
    "name": r"(?i) (?:doe|smithee|example|test)$",
    "secret": r"(?i)(?:example|placeholder|changeme|xxxx|0000000000|your[-_])",
    "ssn": r"^(?:123-45-6789|078-05-1120|219-09-9999)$",
    "tel": r"555.01[0-9]{2}$",
}
VOTERS = ("pattern", "gazetteer", "context")
#: Prior that a labeler is right, in pseudo-counts, and that a candidate is personal; and rounds of estimation.
RIGHT, WRONG, PRIOR, ROUNDS = 8.0, 2.0, (1.0, 1.0), 50


def _sums_before(values: Column) -> Column:
    """Sums of all values before each, in about n ** 1.5 steps."""
    n = F.size(values)
    chunk = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))
    add = lambda a, x: a + x
    heads = F.transform(F.sequence(F.lit(0), F.floor(n / chunk).cast("int")), lambda c: F.aggregate(F.slice(values, 1, (c * chunk).cast("int")), F.lit(0), add))
    return F.transform(values, lambda _, i: F.get(heads, F.floor(i / chunk).cast("int")) + F.aggregate(F.slice(values, (F.floor(i / chunk) * chunk + 1).cast("int"), (i % chunk).cast("int")), F.lit(0), add))


_NO_SPANS = "array<struct<start:int,end:int,match:string>>"


def _found(docs: DataFrame, name: str, text: Column, pattern: str) -> DataFrame:
    """Adds ``name``: all leftmost non-overlapping matches, with their code point offsets."""
    has = text.rlike(NEEDS[name]) if name in NEEDS else F.lit(True)
    raw = f"{name}_raw"
    docs = docs.withColumn(raw, F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    any_match = F.size(raw) > 0
    docs = docs.withColumn(f"{name}_gap", F.when(any_match, F.transform(F.split(text, pattern, -1), lambda x: F.length(x))))
    both = F.transform(F.col(raw), lambda m, i: F.length(m) + F.get(F.col(f"{name}_gap"), i))
    docs = docs.withColumn(f"{name}_at", F.when(any_match, _sums_before(both)))
    spans = F.transform(F.col(raw), lambda m, i: F.struct((F.get(F.col(f"{name}_at"), i) + F.get(F.col(f"{name}_gap"), i)).alias("start"), (F.get(F.col(f"{name}_at"), i) + F.get(F.col(f"{name}_gap"), i) + F.length(m)).alias("end"), m.alias("match")))
    return docs.withColumn(name, F.when(any_match, spans).otherwise(F.array().cast(_NO_SPANS))).drop(raw, f"{name}_gap", f"{name}_at")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    backward = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(backward, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(right: Column, wrong: Column) -> Column:
    return F.when(right & ~wrong, F.lit("+")).when(wrong & ~right, F.lit("-")).otherwise(F.lit("0"))


def _pattern(kind: str, m: Column, before: Column, after: Column) -> Column:
    """What a candidate looks like: its votes, in the order of VOTERS, and its features, one sign each."""
    votes = (
        _vote(m.rlike(STRICT[kind]), m.rlike(LOOSE[kind])),
        _vote(m.rlike(KNOWN[kind]), m.rlike(PLACEHOLDER[kind])),
        _vote(before.rlike(ANNOUNCE[kind]), before.rlike(DENY[kind])),
    )
    classes = F.when(m.rlike(r"\p{Ll}"), 1).otherwise(0) + F.when(m.rlike(r"\p{Lu}"), 2).otherwise(0) + F.when(m.rlike(r"[^\p{L}0-9]"), 4).otherwise(0)
    various = F.size(F.array_distinct(F.split(m, ""))) / F.length(m)
    features = (
        F.when(F.length(m) < 12, "s").when(F.length(m) < 24, "m").when(F.length(m) < 48, "l").otherwise("x"),
        F.least(F.floor(4 * F.length(_digits(m)) / F.length(m)), F.lit(3)).cast("string"),
        classes.cast("string"),
        F.when(before == "", "n").when(before.rlike(r"[\t-\r ]$"), "s").when(before.rlike("[\"'`]$"), "q").when(before.rlike("[=:]$"), "e").otherwise("o"),
        F.when(after == "", "n").when(after.rlike(r"[\t-\r ]"), "s").when(after.rlike("[\"'`.,;:!?)]"), "p").otherwise("o"),
        F.when(various < 0.25, "0").when(various < 0.5, "1").otherwise("2"),
    )
    return F.concat(F.lit(f"{kind}:"), *votes, F.lit(":"), *features)


def _validator(kind: str):
    return lambda s: _valid(kind, s["match"])


def _voter(kind: str, whole: Column):
    def of(s: Column) -> Column:
        before = F.lower(F.substring(whole, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS))))
        after = F.substring(whole, s["end"] + 1, F.lit(1))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), _pattern(kind, s["match"], before, after).alias("pattern"))

    return of


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, the valid base spans by kind, and the candidates of further kinds with their patterns; the text if asked for."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    whole = F.col("text")
    for kind, pattern in BASE.items():
        rows = _found(rows, kind, whole, pattern)
        rows = rows.withColumn(kind, F.transform(F.filter(kind, _validator(kind)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    base = F.concat(*[F.col(k) for k in BASE])
    rows = rows.withColumn("base", base)
    for kind, pattern in PROPOSED.items():
        rows = _found(rows, kind, whole, pattern)
        apart = F.filter(kind, lambda s: ~F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        rows = rows.withColumn(kind, F.transform(apart, _voter(kind, whole)))
    return rows.drop("base") if keep_text else rows.drop("text", "base")


def estimate(counts: dict[str, int]) -> tuple[dict[str, float], dict[str, list[tuple[float, float]]]]:
    """By expectation-maximisation over {pattern: count}: the probability that a pattern is personal, and for each kind
    each labeler's chance to be right on personal and on other spans.

    A labeler that abstains says nothing. The first guess is the majority vote; pseudo-counts keep a labeler that rarely
    speaks near its prior.
    """
    kinds: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for pattern, n in counts.items():
        kind, votes, _ = pattern.split(":")
        kinds[kind][votes] += n
    belief, trust = {}, {}
    for kind, rows in kinds.items():
        silent = "0" * len(VOTERS)
        p = {v: min(0.95, max(0.05, 0.5 + 0.3 * (v.count("+") - v.count("-")) - 0.1 * (v == silent))) for v in rows}
        for _ in range(ROUNDS):
            right = []
            for j in range(len(VOTERS)):
                spoke = [(p[v], v[j], n) for v, n in rows.items() if v[j] != "0"]
                hit, personal = sum(q * n for q, c, n in spoke if c == "+"), sum(q * n for q, _, n in spoke)
                deny, other = sum((1 - q) * n for q, c, n in spoke if c == "-"), sum((1 - q) * n for q, _, n in spoke)
                right.append(((hit + RIGHT) / (personal + RIGHT + WRONG), (deny + RIGHT) / (other + RIGHT + WRONG)))
            spoken = {v: n for v, n in rows.items() if v != silent}
            share = (sum(p[v] * n for v, n in spoken.items()) + PRIOR[0]) / (sum(spoken.values()) + sum(PRIOR))
            for v in rows:
                odds = math.log(share / (1 - share)) if v != silent else math.log(1e-3)
                for (s, t), c in zip(right, v, strict=True):
                    odds += math.log(s / (1 - t)) if c == "+" else math.log((1 - s) / t) if c == "-" else 0.0
                p[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        belief[kind], trust[kind] = p, right
    by_kind = lambda x: x.split(":")
    return {x: belief[by_kind(x)[0]][by_kind(x)[1]] for x in counts}, trust


def train(counts: dict[str, int], belief: dict[str, float]) -> dict[str, float]:
    """The final classifier: for each pattern the log odds of naive Bayes over votes and features, fitted to soft labels."""
    mass: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
    total: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
    values: dict[tuple, set] = defaultdict(set)

    def features(pattern: str):
        kind, votes, more = pattern.split(":")
        return kind, list(enumerate(votes + more))

    for pattern, n in counts.items():
        kind, found = features(pattern)
        for side, q in ((0, belief[pattern]), (1, 1 - belief[pattern])):
            total[kind][side] += q * n
            for f in found:
                mass[kind, f][side] += q * n
        for name, value in found:
            values[kind, name].add(value)
    out = {}
    for pattern in counts:
        kind, found = features(pattern)
        odds = math.log((total[kind][0] + 1) / (total[kind][1] + 1))
        for f in found:
            m = len(values[kind, f[0]])
            odds += math.log((mass[kind, f][0] + 1) / (total[kind][0] + m)) - math.log((mass[kind, f][1] + 1) / (total[kind][1] + m))
        out[pattern] = odds
    return out


def _accept(table: DataFrame) -> DataFrame:
    """``table`` of spans with base and found, arrays of (kind, start, end): the base spans, and with those accepted."""
    patterns = table.select(F.explode(F.concat(*[F.col(k) for k in PROPOSED])).alias("s")).groupBy(F.col("s.pattern").alias("pattern")).count()
    counts = {r["pattern"]: r["count"] for r in patterns.collect()}  # MOST_PATTERNS a kind at most
    belief, _ = estimate(counts)
    odds = train(counts, belief)
    accepted = sorted(x for x in counts if odds[x] > 0)
    label = lambda kind: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    more = [F.transform(F.filter(kind, lambda s: s["pattern"].isin(accepted)) if accepted else F.slice(kind, 1, 0), label(kind)) for kind in PROPOSED]
    base = F.concat(*[F.transform(kind, label(kind)) for kind in BASE])
    return table.withColumn("base", base).withColumn("found", F.concat("base", *more))


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found (all spans), and found,
    an array of (kind, start, end). Offsets are code points, ends are exclusive.

    Whole texts are searched, however long. Null and empty texts have no spans. Repeated rows have equal results; an empty
    table gives an empty result. Other columns, whatever their names, are not looked at.
    """
    rows = _accept(Scratch(docs.sparkSession, "pii").table(spans(docs, doc_id, text), "spans", wide=True))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_found"), "found",
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, match): the found spans as rows, with what they cover. A row of ``docs`` gives its own spans,
    so rows without a doc_id keep theirs, and repeated rows repeat theirs."""
    rows = _accept(Scratch(docs.sparkSession, "pii").table(spans(docs, doc_id, text, keep_text=True), "spans", wide=True))
    rows = rows.select("doc_id", "text", F.explode("found").alias("s"))
    return rows.select("doc_id", "s.kind", "s.start", "s.end", F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("match"))
