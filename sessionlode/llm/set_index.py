"""Prefix index for exact set-similarity joins: which sets can reach a Jaccard threshold, without missing any.

Tokens have one global order, rare ones first (by the frequency sketch, then by value). Two sets that reach the threshold
share a token within the first ``size - required + 1`` of each. The index lists of those tokens are walked as follows: a
list is sorted by set size and, within a size, by the token's position; a probing set walks on from its own place.

- length filter: sizes beyond ``size / threshold`` are never reached;
- positional filter: what can still be shared after the token's position bounds the sizes that are worth a look;
- block skipping: the entries of one size form a block with ascending positions; once a position is too late, the walk
  jumps to the next block, whose first entry is again the earliest;
- list skipping: a list whose sets all have one answer already (one class) is passed over as a whole, and of other lists
  only the sets outside its largest class are walked, against all.

Before any walk, ``leaders`` gives each entry one candidate in a single pass over a list; what these candidates settle needs
no walk. The walk itself tries the pairs that its filters leave, so it takes quadratic time in what leaders do not settle.

No list is longer than about ``HEAVY`` entries, whatever the data: tokens with more are counted exactly and their lists cut.

Similarity is compared in integers: overlap * (num + den) >= num * (size + size).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np

from sessionlode.llm.hashing import U64, mix
from sessionlode.llm.sketches import slot

#: Entries of a list; a token with more has its list cut.
HEAVY = 1 << 16
#: Pairs that a walk gathers before it hands them over.
WALK_PAIRS = 1 << 20
#: Heavy tokens of which the exact counts are shared; with more than that the sketch's upper bounds serve.
MOST_HEAVY = 1 << 22


def required(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap at which sets of these sizes reach num / den."""
    return -((-num * (a + b)) // (num + den))


def prefix_size(n, num: int, den: int):
    return n + 1 + ((-num * n) // den)


def pack(**columns: np.ndarray) -> bytes:
    """Columns in the smallest whole-number types that hold them."""
    out = {}
    for k, v in columns.items():
        if len(v) and v.dtype.kind in "iu":
            low, high = int(v.min()), int(v.max())
            v = v.astype(np.promote_types(np.min_scalar_type(low), np.min_scalar_type(high)), copy=False)
        out[k] = np.ascontiguousarray(v)
    return pickle.dumps(out, protocol=5)


def unpack(parts: list[bytes], dtypes: dict[str, str]) -> dict[str, np.ndarray]:
    loaded = [pickle.loads(x) for x in parts]
    return {k: np.concatenate([x[k].astype(t, copy=False) for x in loaded]) if loaded else np.zeros(0, dtype=t) for k, t in dtypes.items()}


class Lengths:
    """How long each token's list is: exact for the tokens given, at most ``HEAVY`` for all others.

    ``sketch`` has the index entries by slot, an upper bound of each list; only tokens of slots over ``HEAVY`` are looked at.
    """

    def __init__(self, sketch: np.ndarray, tokens: np.ndarray | None = None, counts: np.ndarray | None = None):
        self.heavy = HEAVY
        self.over = sketch > self.heavy
        self.sketch = sketch if tokens is None and self.over.any() else None
        self.tokens, self.counts = tokens, counts

    def of(self, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), dtype=np.int64)
        at = np.flatnonzero(self.over[slot(tokens)])
        if not len(at):
            return out
        if self.tokens is None:
            out[at] = self.sketch[slot(tokens[at])]
        elif len(self.tokens):
            place = np.minimum(np.searchsorted(self.tokens, tokens[at]), len(self.tokens) - 1)
            out[at] = np.where(self.tokens[place] == tokens[at], self.counts[place], 0)
        return out

    def chunks(self, tokens: np.ndarray) -> np.ndarray:
        return -(-self.of(tokens) // self.heavy)


def spread(tokens: np.ndarray, owners: np.ndarray, lengths: Lengths) -> tuple[np.ndarray, np.ndarray]:
    """List keys for index entries, and which entry each belongs to.

    The list of a token with more than ``HEAVY`` entries is cut into chunks by owner, and each pair of chunks gets a list of
    its own, so every two entries still meet, and no list is longer than about twice ``HEAVY``.
    """
    chunks = lengths.chunks(tokens)
    heavy = np.flatnonzero(chunks > 1)
    every = np.arange(len(tokens))
    if not len(heavy):
        return tokens, every
    keys, index = [np.delete(tokens, heavy)], [np.delete(every, heavy)]
    for i in heavy:
        c = int(chunks[i])
        own = int(mix(owners[i : i + 1].astype(np.uint64))[0] % U64(c))
        other = np.arange(c, dtype=np.uint64)
        keys.append(mix(tokens[i] + mix(np.minimum(other, U64(own)) * U64(c) + np.maximum(other, U64(own)) + U64(1))))
        index.append(np.full(c, i))
    return np.concatenate(keys), np.concatenate(index)


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the run of equal rows that each row is in."""
    n = len(columns[0])
    new = np.zeros(n - 1, dtype=bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    cuts = np.flatnonzero(new) + 1
    sizes = np.diff(np.concatenate(([0], cuts, [n])))
    return np.repeat(np.concatenate(([0], cuts)), sizes), np.repeat(np.append(cuts, n), sizes)


def _reach(size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest size that each entry can reach, by length and by what is left after its position."""
    return np.minimum(size * den // num, (size - place) * (num + den) // num - size)


def passes(i: np.ndarray, j: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the pairs (i, j) of entries of one list pass the length and positional filters."""
    a, b = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    need = required(a, b, num, den)
    return (b * num <= a * den) & (size[i] - place[i] >= need) & (size[j] - place[j] >= need)


def leaders(run: np.ndarray, size: np.ndarray, place: np.ndarray, first: np.ndarray, num: int, den: int, group: np.ndarray | None = None, fits: Callable | None = None) -> np.ndarray:
    """For each entry one other of its list that passes the filters, or -1: the one that comes first by ``first`` in the whole
    list, else among those of its own size, else among those of the next smaller one. With ``group``, one of another group.
    One pass; entries are sorted by (run, size, place).
    """
    n = len(run)
    out = np.full(n, -1)
    if n < 2:
        return out
    group = first if group is None else group

    # Ranks, so that rank and place fit one number, of which the least gives the first entry.
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(n)
    packed, none = rank * n + np.arange(n), np.iinfo(np.int64).max

    def firsts(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch of equal columns the first entry, and the first one of another group; and each entry's stretch."""
        new = np.zeros(n, dtype=bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        new[0] = True
        begin, mine = np.flatnonzero(new), np.cumsum(new) - 1
        best = np.minimum.reduceat(packed, begin) % n
        second = np.minimum.reduceat(np.where(group != group[best][mine], packed, none), begin)
        return best, np.where(second < none, second % n, -1), mine

    def try_these(best, second, mine, ok):
        a, b = best[mine], second[mine]
        pick = np.where(group[a] != group, a, b)
        todo = np.flatnonzero((out < 0) & ok & (pick >= 0))
        todo = todo[passes(todo, pick[todo], size, place, num, den)]
        if fits is not None and len(todo):
            todo = todo[fits(todo, pick[todo])]
        out[todo] = pick[todo]

    every = np.ones(n, dtype=bool)
    try_these(*firsts(run), every)
    best, second, number = firsts(run, size)
    try_these(best, second, number, every)
    before = np.maximum(number - 1, 0)
    try_these(best, second, before, (number > 0) & (run[best[before]] == run))
    return out


def reachable(run: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether an entry's neighbours in its list, by size, leave room for a partner; false only if there is none."""
    n = len(run)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    same = run[1:] == run[:-1]
    out[:-1] = same & (size[1:] <= _reach(size, place, num, den)[:-1])
    least = -(-num * size // den)  # the smallest partner that the length filter allows
    out[1:] |= same & (size[:-1] >= least[1:]) & ((size - place)[1:] >= required(size, least, num, den)[1:])
    return out


def walk(run: np.ndarray, size: np.ndarray, place: np.ndarray, num: int, den: int, keep: Callable | None = None, probes: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of entries in a list that pass all filters and ``keep(i, j)``, a bounded lot at a time, each pair once.

    ``run`` numbers the lists; entries are sorted by (run, size, place). Without ``probes`` i comes before j; with it (a
    mask), only pairs with at least one of them: those among themselves, and those with all others.
    """
    if len(run) < 2:
        return
    if probes is None:
        at = np.arange(len(run))
        yield from _pairs(run, size, place, at, at, num, den, keep)
        return
    at, rest = np.flatnonzero(probes), np.flatnonzero(~probes)
    yield from _pairs(run, size, place, at, at, num, den, keep)
    yield from _pairs(run, size, place, at, rest, num, den, keep)


def _pairs(run, size, place, ours: np.ndarray, theirs: np.ndarray, num: int, den: int, keep: Callable | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries out of ``ours`` and ``theirs`` (indices, ascending), which are one and the same or have none in common."""
    m = len(theirs)
    if not len(ours) or not m:
        return
    same = ours is theirs
    run_b, size_b, left_b = run[theirs], size[theirs], (size - place)[theirs]
    _, block_end = _runs(run_b, size_b)
    run_a, size_a, left_a, top = run[ours], size[ours], (size - place)[ours], _reach(size, place, num, den)[ours]
    last = np.searchsorted(run_b, run_a, side="right")
    if same:
        j = np.arange(m) + 1
    else:  # lists and sizes as one ascending number, to find the smallest partner
        wide = int(size.max()) + 1
        j = np.searchsorted(run_b * wide + size_b, run_a * wide + -(-num * size_a // den))
    i = np.flatnonzero(j < last)
    j = j[i]
    got_i, got_j, held = [], [], 0
    while len(i):
        alive = (j < last[i]) & (size_b[np.minimum(j, m - 1)] <= top[i])
        i, j = i[alive], j[alive]
        if not len(i):
            break
        need = required(size_a[i], size_b[j], num, den)
        late = left_b[j] < need
        ok = ~late if same else ~late & (left_a[i] >= need)
        a, b = ours[i[ok]], theirs[j[ok]]
        if keep is not None and len(a):
            good = keep(a, b)
            a, b = a[good], b[good]
        if len(a):
            got_i.append(a)
            got_j.append(b)
            held += len(a)
            if held >= WALK_PAIRS:
                yield np.concatenate(got_i), np.concatenate(got_j)
                got_i, got_j, held = [], [], 0
        j = np.where(late, block_end[j], j + 1)
    if held:
        yield np.concatenate(got_i), np.concatenate(got_j)
