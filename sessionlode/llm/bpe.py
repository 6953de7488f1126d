"""Exact BPE encoding by backtracking, and decoding through an offset table.

Encoding never replays merges. An Aho-Corasick automaton finds the longest vocabulary entry at every position of a
pre-token; the encoder walks left to right over those matches, shortens a match through a next-shorter-prefix table, and
steps back where no entry fits. Two neighbours are accepted only if no merge could have joined across their border earlier
than their own merges were made; that test runs on the merge tree, and its outcomes are kept in a pair-compatibility table.
Every position is refused at most once, so the time is linear in the text, and the result is the one that replaying the
merges gives.

Decoding concatenates slices of one byte blob, addressed by an offset table over token ids.

Files: the JSON of the ``tokenizers`` library with a BPE model, optional end-of-word suffix, byte-level alphabet, and the
normaliser NFC, white-space folding, lower case; ``Encoder`` refuses settings that it does not know. The driver reads the
file and broadcasts it, within ``MOST_FILE_BYTES``; executors never look for the path.

Texts of any length are encoded and decoded in pieces, cut at white space, which no token spans.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlode.llm.hashing import release_memory

CACHE_WORDS = 120_000
CACHE_CHARS = 64
PAIR_SLOTS = 1 << 18
#: Characters of a text, and ids of its code, that are held in work at a time.
PIECE = 1 << 18
MOST_FILE_BYTES = 64 << 20
WHITE = re.compile(r"[\t-\r ]")


@lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Encoder:
    """Encodes with one tokenizer file. Symbols are code points; a word's last symbol carries the suffix, if there is one."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token", "fuse_unk")):
            raise ValueError("only plain BPE models are supported")
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["normalizer"]["normalizers"][1]["content"] != " ":
            raise ValueError(f"unknown normalizer {kinds}")
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError("unknown pre-tokenizer")
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("decoders and post-processors are not supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens", [])):
            raise ValueError("only plain added tokens are supported")
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.special_bytes = {x: np.uint32(i).tobytes() for x, i in self.special.items()}
        self.special_starts = sorted({x[0] for x in self.special})
        self.cut_free = not any(WHITE.search(x) for x in self.special)
        self._tables(model)
        self._offsets(model["vocab"])
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    @lru_cache(maxsize=2)
    def load(path: str) -> Encoder:
        """One encoder per process and file."""
        with open(path, encoding="utf-8") as f:
            return Encoder(json.load(f))

    def _symbols(self, token: str) -> str:
        """A vocabulary entry over single code points: its last is moved up by 0x400 if the entry ends a word."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + 0x400)
        return token

    def _tables(self, model: dict) -> None:
        vocab, merges = model["vocab"], [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        joined = lambda a, b: a + b
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for n, (a, b) in enumerate(merges):
            whole = vocab[joined(a, b)]
            self.rank[vocab[a], vocab[b]] = (n, whole)
            made.setdefault(whole, (n, vocab[a], vocab[b]))
        size = max(vocab.values()) + 1
        self.order = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        for whole, (n, a, b) in made.items():
            self.order[whole], self.left[whole], self.right[whole] = n, a, b
        self.pairs: dict[int, bool] = {}
        text = {i: self._symbols(t) for t, i in vocab.items()}
        self.length = [len(text.get(i, "")) for i in range(size)]
        # An entry that its own merges do not lead to is never the outcome for any text; it stays out of the automaton.
        reachable = {i for i in text if i not in made and self.length[i] == 1}
        for whole, (_, a, b) in sorted(made.items(), key=lambda x: x[1][0]):
            if a in reachable and b in reachable and self._fits(a, b, whole):
                reachable.add(whole)
        self.ids = {text[i]: i for i in reachable}
        self.automaton = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.automaton.add_word(word, (i, len(word)))
        self.automaton.make_automaton()
        self.shorter = [-1] * size
        for i in reachable:
            word = text[i]
            self.shorter[i] = next((self.ids[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in self.ids), -1)
        self.last = {c: chr(ord(c) + 0x400) for c in byte_alphabet()} if self.suffix else {}

    def _fits(self, a: int, b: int, whole: int = -1) -> bool:
        """Whether the entries ``a`` and ``b`` can stay neighbours (but for the merge that makes ``whole`` of them).

        Undo the later of the two innermost merges step by step, and see at each step whether the pair that then faced each
        other would have been merged before that step's entry came to be.
        """
        order, rank, left, right = self.order, self.rank, self.left, self.right
        limit = order[whole] if whole >= 0 else 1 << 60
        inclusive = whole < 0
        while True:
            hit = rank.get((a, b))
            if hit is not None and (hit[0] < limit or (inclusive and hit[0] == limit)):
                return False
            x, y = order[a], order[b]
            if x < 0 and y < 0:
                return True
            # Of two merges of one rank on either side of a border the left one came first.
            if x > y:
                limit, inclusive, a = x, False, right[a]
            else:
                limit, inclusive, b = y, True, left[b]

    def _compatible(self, a: int, b: int) -> bool:
        key = (a << 32) | b
        out = self.pairs.get(key)
        if out is None:
            if len(self.pairs) >= PAIR_SLOTS:
                self.pairs.clear()
            out = self.pairs[key] = self._fits(a, b)
        return out

    def pre_token(self, word: str) -> list[int]:
        """Ids of one pre-token, given as text."""
        alphabet = byte_alphabet()
        symbols = "".join([alphabet[b] for b in word.encode("utf-8", "surrogatepass")])
        if self.suffix:
            symbols = symbols[:-1] + self.last[symbols[-1]]
        whole = self.ids.get(symbols)
        if whole is not None:
            return [whole]
        longest = [-1] * (len(symbols) + 1)
        for end, (i, n) in self.automaton.iter(symbols):
            longest[end - n + 1] = i  # ends ascend, so the longest entry at a start comes last
        length, shorter, compatible = self.length, self.shorter, self._compatible
        open_at = bytearray(b"\x01") * (len(symbols) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + length[token]
                if open_at[end] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                token = shorter[token]
                if token < 0:
                    open_at[at] = 0
                    out.pop()
                    at -= length[last]
                    token = last  # its end is closed now, so it will be shortened, or stepped over in turn
                    break
        return out

    def _word(self, word: str) -> bytes:
        """Ids as little-endian 32-bit bytes, through a cache of two generations of bounded size."""
        out = self.old.get(word)
        if out is None:
            out = np.array(self.pre_token(word), dtype="<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.young) >= CACHE_WORDS:
                self.old, self.young = self.young, {}
            self.young[word] = out
        return out

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case goes by code point, so there is no final sigma
                text = text.replace("Σ", "σ")
        words = self.split.findall(text.lower())
        young = self.young
        try:
            return b"".join([young[w] for w in words])
        except KeyError:
            pass
        parts = []
        for w in words:
            got = self.young.get(w)
            parts.append(self._word(w) if got is None else got)
        return b"".join(parts)

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about ``PIECE`` characters, cut at white space."""
        at = 0
        while at < len(text):
            cut = WHITE.search(text, at + PIECE) if self.cut_free else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; null and empty texts have none."""
        if not text:
            return b""
        if len(text) > 2 * PIECE:
            return b"".join(map(self._encoded, self._pieces(text)))
        return self._encoded(text)

    def _encoded(self, text: str) -> bytes:
        if not any(c in text for c in self.special_starts):
            return self._plain(text)
        return b"".join(self.special_bytes[x] if k % 2 else self._plain(x) for k, x in enumerate(self.special_split.split(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def _offsets(self, vocab: dict[str, int]) -> None:
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token.encode("utf-8") + b" "
        self.blob = np.frombuffer(b"".join(names), dtype=np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64)
        self.sizes = np.diff(self.starts)

    def decoded_parts(self, ids: bytes) -> Iterator[bytes]:
        """UTF-8 of the decoded text: the tokens' strings with a space between, special tokens included; in pieces."""
        at = np.frombuffer(ids, dtype="<u4")
        for first in range(0, len(at), PIECE):
            part = at[first : first + PIECE]
            sizes = self.sizes[part]
            ends = np.cumsum(sizes)
            index = np.repeat(self.starts[part] - ends + sizes, sizes)
            index += np.arange(len(index), dtype=np.int64)
            out = self.blob[index].tobytes()
            yield out if first + PIECE < len(at) else out[:-1]

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(self.decoded_parts(ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, dtype="<u4").tobytes()).decode("utf-8", "surrogatepass")


def _texts(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[tuple[int, list]]:
    """Slices of the first column with about ``limit`` characters at most, so that a batch is never held twice."""
    column = batch.column(0)
    rows = max(1, min(len(column), int(len(column) * limit / max(1, column.nbytes))))
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the array<int> column ``ids``: the encoded whole text, however long (null and empty texts: no tokens).

    All other columns pass through, whatever their names; a column named ``ids`` is replaced. Rows are independent, so
    repeated rows give repeated results and an empty table stays empty.
    """
    return _map(docs, text, [(ids, pa.list_(pa.int32()), "array<int>")], _Encode(docs.sparkSession, path))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the string column ``text`` decoded from the array<int> column ``ids`` (null: empty)."""
    return _map(docs, ids, [(text, pa.string(), "string")], _Decode(docs.sparkSession, path))


def round_trip(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text) with n_tokens, ids_sha256 and decoded_sha256 of each whole text, in one pass. Nulls,
    long texts and other columns as in ``encode``."""
    columns = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _map(docs, text, columns, _Digests(docs.sparkSession, path), keep_text)


def count(docs: DataFrame, path: str, text: str = "text", n: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """``docs`` (without the text) with the bigint column ``n``: tokens of each whole text (null: 0)."""
    return _map(docs, text, [(n, pa.int64(), "bigint")], _Count(docs.sparkSession, path), keep_text)


_LOADED: dict[str, Encoder] = {}


class _Encode:
    """Work on the values of one column, with the encoder of a file that the driver has read."""

    def __init__(self, spark: SparkSession, path: str):
        if "://" in path:
            data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
        else:
            with open(path, "rb") as f:
                data = f.read()
        if len(data) > MOST_FILE_BYTES:
            raise ValueError(f"a tokenizer file of {len(data)} bytes is not broadcast")
        self.key, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(zlib.compress(data))

    def coder(self) -> Encoder:
        if self.key not in _LOADED:
            _LOADED.clear()
            _LOADED[self.key] = Encoder(json.loads(zlib.decompress(self.data.value)))
        return _LOADED[self.key]

    def __call__(self, texts):
        coder = self.coder()
        return [pa.array([np.frombuffer(coder.encode_bytes(x), dtype="<i4") for x in texts], type=pa.list_(pa.int32()))]


class _Decode(_Encode):
    def __call__(self, ids):
        coder = self.coder()
        return [pa.array([coder.decode(x or []) for x in ids], type=pa.string())]


class _Digests(_Encode):
    def __call__(self, texts):
        coder = self.coder()
        n, first, second = [], [], []
        for x in texts:
            ids = coder.encode_bytes(x)
            n.append(len(ids) // 4)
            first.append(hashlib.sha256(ids).hexdigest())
            digest = hashlib.sha256()
            for part in coder.decoded_parts(ids):
                digest.update(part)
            second.append(digest.hexdigest())
        return [pa.array(n, type=pa.int64()), pa.array(first), pa.array(second)]


class _Count(_Encode):
    def __call__(self, texts):
        coder = self.coder()
        return [pa.array([len(coder.encode_bytes(x)) // 4 for x in texts], type=pa.int64())]


def _map(docs: DataFrame, source: str, columns: list[tuple[str, pa.DataType, str]], work, keep_source: bool = True) -> DataFrame:
    """Adds columns made from the column ``source``, which moves first on the way to Python."""
    names = [x for x, _, _ in columns]
    kept = [c for c in docs.columns if c not in names and (keep_source or c != source)]
    positions = {c: f"c{k}" for k, c in enumerate(kept)}
    sent = docs.select(F.col(f"`{source}`").alias("x"), *[F.col(f"`{c}`").alias(positions[c]) for c in kept if c != source])
    order = [c for c in kept if c != source]
    keep_source = source in kept

    def run(batches):
        for batch in batches:
            for at, values in _texts(batch):
                part = batch.slice(at, len(values))
                rest = list(part.columns)
                yield pa.RecordBatch.from_arrays([*(rest if keep_source else rest[1:]), *work(values)], names=out_names)
        release_memory()

    out_names = [*(["x"] if keep_source else []), *[positions[c] for c in order], *names]
    fields = [*([f"x {docs.schema[source].dataType.simpleString()}"] if keep_source else []), *[f"{positions[c]} {docs.schema[c].dataType.simpleString()}" for c in order], *[f"`{n}` {t}" for n, _, t in columns]]
    made = sent.mapInArrow(run, ", ".join(fields))
    return made.select(*[(F.col("x") if c == source else F.col(positions[c])).alias(c) for c in kept], *[F.col(f"`{n}`") for n in names])
