"""Small awkward tables, and plain-Python versions of the operators."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(seed=1, n=60):
    """Copies, near copies, shared lines, nulls, blank and long texts, repeated rows, a null id."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    line = lambda k: " ".join(rng.choices(vocab, k=k)).capitalize() + "."
    shared = [line(12) for _ in range(4)]
    texts = []
    for _ in range(n):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared))
        texts.append("\n".join(lines))
    for k in range(n // 3):
        words = texts[k].split(" ")
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), texts[1], None, "", "   \n\t ", "one", "one two", "One  two", "é ß x", "\n\n", "x" * 5000, " ".join(rng.choices(vocab, k=4000)), "a b c d e " * 50]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, texts[0], "en", "s0", 1), (None, None, None, None, None)]


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}) if fold else text)


def shingles(text, width):
    w = words(text, True)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(rows, width, num, den):
    """{doc_id: (set size, least doc_id reached)}."""
    sets = {r[0]: shingles(r[1], width) for r in rows if r[0] is not None}
    least = {d: d for d in sets}

    def find(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeated(rows, num=8, den=10):
    """{doc_id: sorted lines that match an earlier one}."""
    seen, out = [], defaultdict(set)
    for d, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1]}):
        for k, line in enumerate(text.split("\n")):
            s = frozenset(words(line))
            if s and any(den * len(s & o) >= num * len(s | o) for o in seen):
                out[d].add(k)
            if s:
                seen.append(s)
    return {d: sorted(x) for d, x in out.items()}
