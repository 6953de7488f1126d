"""Language identification as a mixture of languages.

Each language has a distribution over byte n-grams, hashed into a table of fixed size, learned by one count over labelled
documents. A document is a mixture: expectation-maximisation over its n-grams estimates the proportion of each language.
A language that adds less to the likelihood than the penalty for one more parameter (half the log of the number of
n-grams, times ``penalty``) is taken out again, trifling ones together, then least proportion first; what stays is the document's language set, and
the largest proportion names its language.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlode.llm.hashing import WHITE, release_memory, text_slices

ORDER = 4
TABLE_BITS = 16
SMOOTH = 0.05
ROUNDS = 12
PENALTY = 4.0
TRIFLE = 0.03
#: Bytes worked on at a time: what a step makes of them fits the cache.
SLICE = 1 << 18
#: Models of more languages are refused: a language has 512 KB of counts on their way to the driver and 256 KB in the broadcast.
MOST_LANGUAGES = 256


def _grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (one row of the text after another) and their row bounds. ASCII case is folded, white space is one sign."""
    folded = data.copy()
    upper = (folded >= 65) & (folded <= 90)
    folded[upper] += 32
    # Latin-1 letters in UTF-8: C3 80..9E are the capitals of C3 A0..BE.
    after = np.zeros(len(data), dtype=bool)
    after[1:] = data[:-1] == 0xC3
    folded[after & (data >= 0x80) & (data <= 0x9E)] += 32
    folded[WHITE[data]] = 32
    x = folded.astype(np.uint32)
    n = max(0, len(x) - ORDER + 1)
    h = np.zeros(n, dtype=np.uint32)
    for k in range(ORDER):
        h = (h * np.uint32(0x01000193)) ^ x[k : k + n]
    h *= np.uint32(0x9E3779B1)
    h >>= np.uint32(32 - TABLE_BITS)
    sizes = np.diff(starts)
    ends = np.maximum(starts[1:] - ORDER + 1, starts[:-1])
    keep = np.zeros(n + 1, dtype=np.int32)
    np.add.at(keep, np.minimum(starts[:-1], n), 1)
    np.add.at(keep, np.minimum(ends, n), -1)
    inside = np.cumsum(keep[:n]) > 0
    counts = np.maximum(sizes - ORDER + 1, 0)
    return h[inside].astype(np.int64), np.concatenate(([0], np.cumsum(counts)))


def _long(data: np.ndarray, starts: np.ndarray) -> bool:
    """Whether this is one row that goes in pieces."""
    return len(starts) == 2 and len(data) > 2 * SLICE


def _counted(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram, count), sorted by row and n-gram. One long row goes in pieces that overlap by an n-gram."""
    if _long(data, starts):
        total = np.zeros(1 << TABLE_BITS, dtype=np.int64)
        for at in range(0, len(data) - ORDER + 1, SLICE):
            # One byte more in front, for letters of two bytes; its own n-gram is left out.
            first = max(0, at - 1)
            piece = data[first : at + SLICE + ORDER - 1]
            total += np.bincount(_grams(piece, np.array([0, len(piece)]))[0][at - first :], minlength=len(total))
        gram = np.flatnonzero(total)
        return np.zeros(len(gram), dtype=np.int64), gram, total[gram]
    grams, bounds = _grams(data, starts)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    packed = np.sort((row << TABLE_BITS) | grams)
    new = np.ones(len(packed), dtype=bool)
    new[1:] = packed[1:] != packed[:-1]
    at = np.flatnonzero(new)
    return packed[at] >> TABLE_BITS, packed[at] & ((1 << TABLE_BITS) - 1), np.diff(np.append(at, len(packed)))


class Model:
    """Log probabilities (2**TABLE_BITS, languages), the languages' names, in order, and their shares of what was learned."""

    def __init__(self, names: list[str], table: np.ndarray, prior: np.ndarray):
        self.names, self.table, self.prior = names, table.astype(np.float32), prior


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Counts the n-grams of all rows with a language. Rows without text or language teach nothing.

    What a task ships is a table of fixed size per language that it saw, and what the driver gets one per language; there can
    be ``MOST_LANGUAGES``.
    """
    width = 1 << TABLE_BITS

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for row, data, starts in text_slices(batch.column(0), SLICE):
                owner = langs[row : row + len(starts) - 1]
                for name in set(owner):
                    totals.setdefault(name, np.zeros(width, dtype=np.int64))
                if _long(data, starts):
                    _, gram, n = _counted(data, starts)
                    totals[owner[0]][gram] += n
                    continue
                grams, bounds = _grams(data, starts)
                for name in set(owner):
                    totals[name] += np.bincount(grams[np.repeat(owner == name, np.diff(bounds))], minlength=width)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    counted = rows.mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def pack(table: pa.Table) -> pa.Table:
        total = np.zeros(width, dtype=np.int64)
        total[table.column("gram").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()]), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    packed = counted.groupBy("lang").applyInArrow(pack, "lang string, counts binary").limit(MOST_LANGUAGES + 1).toArrow()
    if packed.num_rows > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    found = sorted(zip(packed.column("lang").to_pylist(), packed.column("counts").to_pylist(), strict=True))
    table = np.zeros((width, len(found)))
    for k, (_, counts) in enumerate(found):
        table[:, k] = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
    seen = table.sum(axis=0)
    table += SMOOTH
    return Model([name for name, _ in found], np.log(table / table.sum(axis=0)) if found else table, seen / max(1.0, seen.sum()))


def _mixtures(model: np.ndarray, n: int, row: np.ndarray, gram: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """(rows, languages) proportions after selection, for ``n`` rows with counted n-grams (row, gram, weight), sorted by row;
    rows without n-grams get zeros. All rows step together."""
    languages = model.shape[1]
    out = np.zeros((n, languages))
    rows = row[np.append(True, row[1:] != row[:-1])] if len(row) else row
    if not len(rows) or not languages:
        return out
    weight = weight.astype(np.float32)
    first = np.searchsorted(row, rows)
    total = np.add.reduceat(weight, first).astype(np.float64)
    # One row a language, so that sums over languages run along memory.
    like = np.ascontiguousarray(model.T[:, gram])
    like -= like.max(axis=0)
    np.exp(like, out=like)
    sizes = np.diff(np.append(first, len(row)))

    def fit(live: np.ndarray, like, weight, first, sizes, total):
        """Proportions and log likelihood (up to a constant) of the given rows with the languages in ``live``."""
        share = live / live.sum(axis=1, keepdims=True)
        rounds = ROUNDS if live.sum(axis=1).max() > 1 else 0
        joint = np.empty_like(like)
        for k in range(rounds + 1):
            for j in range(languages):
                np.multiply(like[j], np.repeat(share[:, j].astype(np.float32), sizes), out=joint[j])
            mass = joint[0].copy()
            for j in range(1, languages):
                mass += joint[j]
            np.maximum(mass, 1e-30, out=mass)
            if k == rounds:
                return share, np.add.reduceat(weight * np.log(mass), first)
            np.divide(weight, mass, out=mass)
            joint *= mass
            share = np.add.reduceat(joint, first, axis=1).T.astype(np.float64) / total[:, None]
        return None

    live = np.ones((len(rows), languages))
    share, score = fit(live, like, weight, first, sizes, total)
    cost = penalty * 0.5 * np.log(total + 1)

    def without(todo: np.ndarray, trial: np.ndarray) -> np.ndarray:
        """Takes languages out of the rows ``todo`` where that costs less than the penalty; gives the rows where it did."""
        # Rows that are down to one language need no rounds, so they go apart.
        for some in (trial.sum(axis=1) == 1, trial.sum(axis=1) > 1):
            if not some.any():
                continue
            at = todo[some]
            pick = np.zeros(len(rows), dtype=bool)
            pick[at] = True
            inner = np.repeat(pick, sizes)
            part = np.concatenate(([0], np.cumsum(sizes[at])[:-1]))
            new_share, new_score = fit(trial[some], like[:, inner], weight[inner], part, sizes[at], total[at])
            ok = score[at] - new_score < cost[at] * (live[at].sum(axis=1) - trial[some].sum(axis=1))
            live[at[ok]], share[at[ok]], score[at[ok]] = trial[some][ok], new_share[ok], new_score[ok]
        return todo[(live[todo] == trial).all(axis=1)]

    # All languages of a trifling share in one go, then the least one at a time.
    trial = np.where((share < TRIFLE) & (share < share.max(axis=1, keepdims=True)), 0.0, live)
    todo = np.flatnonzero((trial != live).any(axis=1))
    without(todo, trial[todo])
    todo = np.arange(len(rows))
    while len(todo := todo[live[todo].sum(axis=1) > 1]):
        trial = live[todo].copy()
        trial[np.arange(len(todo)), np.where(trial > 0, share[todo], np.inf).argmin(axis=1)] = 0
        todo = without(todo, trial)
    out[rows] = share * (live > 0)
    return out


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), penalty: float = PENALTY) -> DataFrame:
    """One row per row of ``docs``: doc_id, the columns in ``keep``, lang_pred, score (the proportion of lang_pred, 0 to 1)
    and languages, an array of (lang, share), the largest first.

    ``und`` with score 0 and no languages where the text is null, has no letter, or nothing was learned. A text of letters
    too short for an n-gram goes to the language that most was learned of (the first by name, if several), with its share.
    Whole texts are read, a very long one in pieces. Repeated rows have equal results; an empty table gives an empty result.
    Other columns, whatever their names, are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(0)
            for row, data, starts in text_slices(texts, SLICE):
                n = len(starts) - 1
                share = _mixtures(m.table, n, *_counted(data, starts), penalty)
                share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                best = share.argmax(axis=1) if m.names else np.zeros(n, dtype=int)
                names, scores, sets = [], [], []
                for i, x in enumerate(texts.slice(row, n).to_pylist()):
                    if not x or not m.names or not any(map(str.isalpha, x)):
                        names.append("und")
                        scores.append(0.0)
                        sets.append([])
                    elif not share[i].any():
                        names.append(m.names[m.prior.argmax()])
                        scores.append(float(m.prior.max()))
                        sets.append([{"lang": m.names[k], "share": float(m.prior[k])} for k in np.argsort(-m.prior, kind="stable")])
                    else:
                        names.append(m.names[best[i]])
                        scores.append(min(1.0, float(share[i, best[i]])))
                        sets.append([{"lang": m.names[k], "share": float(share[i, k])} for k in np.argsort(-share[i], kind="stable") if share[i, k] > 0])
                yield pa.RecordBatch.from_arrays([*(c.slice(row, n) for c in batch.columns[1:]), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, languages)], names=out_names)
        release_memory()

    languages = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    columns = ["doc_id", *keep]
    out_names = [*columns, "lang_pred", "score", "languages"]
    sent = docs.select(F.col(f"`{text}`").cast("string"), F.col(f"`{doc_id}`").alias("doc_id"), *[F.col(f"`{c}`") for c in keep])
    types = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    return sent.mapInArrow(run, ", ".join([*[f"`{c}` {types[c]}" for c in columns], "lang_pred string", "score double", "languages array<struct<lang:string,share:double>>"]))


def held_out(doc_id, parts: int = 3, part: int = 1):
    """Whether crc32 of the id as text falls in the held-out part (null: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages for each row; learned from the rows that are not held out."""
    marked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"), held_out(F.col(f"`{doc_id}`")).alias("held_out"))
    model = train(marked.where(~F.col("held_out")))
    return predict(marked, model, keep=("held_out",))


