"""Byte-pair encoding and decoding with a public vocabulary file (operator 8).

The vocabulary file (``tokenizers`` JSON of a BPE model over bytes with an end-of-word suffix) is a
path parameter.  Texts are normalized (NFC, lower case), cut into words, and the words that a worker has
not met are encoded together: the symbols of all of them lie in one flat array, each round looks up
every adjacent pair by binary search over the sorted pair keys, takes the lowest rank in each word
and merges all its occurrences there.  Finished words leave the array.

Merging all occurrences of a word's best pair at once equals merging them one by one from the left,
because a pair that contains a new symbol always ranks after the pair that made the symbol.

Null texts are empty; an empty text has no tokens and decodes to the empty text.  Strings of special
tokens inside a text become their ids, as the library does.  Rows are independent, so repeated rows
give repeated results; other columns pass through ``encode`` unchanged unless they carry the name of
a result column, which the result replaces.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import column_array, prepare

#: entries in each half of a worker's caches, and longest entry kept (neither changes results)
CACHE_ENTRIES, CACHE_CHARS = 250_000, 40
WORDS_AT_ONCE = 16_000
END = "</w>"
# fixed value: the split pattern of the vocabulary file
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 itself, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]
SPACE, ODD = regex.compile(r"\s+"), re.compile("[\x1c-\x1f]")


class Recent:
    """A cache of two halves: when the younger is full it becomes the older, which is dropped."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if len(key) > CACHE_CHARS:
            return
        if len(self.young) >= CACHE_ENTRIES:
            self.old, self.young = self.young, {}
        self.young[key] = value


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_symbols()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + END] for c in chars], np.int64)
        self.width = np.int64(size)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_word, self.by_chunk = Recent(), Recent()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs by binary search; rank ``len(keys)`` where no merge exists."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], len(self.keys)), self.made[at]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32 bit) of each word, all merged together round by round."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        sym = self.first[flat]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[flat[ends]]
        out: list[bytes] = [b""] * len(raw)
        none = len(self.keys)
        # rank and product of the pair that begins at each symbol; looked up again only where a merge changed it
        rank = np.full(len(sym), none, np.int64)
        made = np.zeros(len(sym), np.int64)
        stale = np.flatnonzero(word[:-1] == word[1:])
        while len(sym):
            rank[stale], made[stale] = self.ranks(sym[stale], sym[stale + 1])
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, begin)
            count = np.diff(np.r_[begin, len(sym)])
            over = best == none
            if over.any():
                ids = sym.astype("<u4").tobytes()
                for w, b, c in zip(word[begin[over]].tolist(), (4 * begin[over]).tolist(), (4 * count[over]).tolist(), strict=True):
                    out[w] = ids[b:b + c]
                stay = np.repeat(~over, count)
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                best, count = best[~over], count[~over]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, count)
            # in a run of overlapping equal pairs (aaa) every second one, from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= (run % 2) == 1
            pos = np.flatnonzero(hit)
            sym[pos] = made[pos]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            now = pos - np.arange(len(pos))  # places of the new symbols after the gaps closed
            stale = np.union1d(now, now[now > 0] - 1)
            rank[stale] = none
            stale = stale[stale + 1 < len(sym)]
            stale = stale[word[stale] == word[stale + 1]]
        return out

    def words(self, chunk: str) -> list:
        """Words of a piece without white space; ids in place of special tokens."""
        if self.special_re is not None and "<" in chunk and (m := self.special_re.search(chunk)):
            return [*self.words(chunk[:m.start()]), self.special[m.group()], *self.words(chunk[m.end():])]
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        # a final sigma must not be lowered by its place in the word
        return WORD.findall("".join(map(str.lower, chunk)) if "Σ" in chunk else chunk.lower())

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        parts = [self.words(c) for c in chunks]
        known: dict = {}
        fresh = []
        for w in {w for row in parts for w in row}:
            if isinstance(w, int):
                known[w] = np.array([w], "<u4").tobytes()
            elif (ids := self.by_word.get(w)) is not None:
                known[w] = ids
            else:
                fresh.append(w)
        for lo in range(0, len(fresh), WORDS_AT_ONCE):
            some = fresh[lo:lo + WORDS_AT_ONCE]
            for w, ids in zip(some, self.encode_words(some), strict=True):
                known[w] = ids
                self.by_word.put(w, ids)
        return {c: b"".join([known[w] for w in row]) for c, row in zip(chunks, parts, strict=True)}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No word, composed character or special token spans white space, so texts are first cut
        there, and each distinct piece of the batch is looked up or encoded once.
        """
        # str.split() also cuts at U+001C..U+001F, which are no white space for the pattern
        parts = [SPACE.split(t) if ODD.search(t) else t.split() for t in texts]
        distinct: set[str] = set()
        distinct.update(*parts)
        known, fresh = {}, []
        for c in distinct:
            if (ids := self.by_chunk.get(c)) is None:
                fresh.append(c)
            else:
                known[c] = ids
        for c, ids in self.learn(fresh).items():
            known[c] = ids
            self.by_chunk.put(c, ids)
        get = known.__getitem__
        return [b"".join(map(get, row)) for row in parts]

    def decode(self, ids: bytes) -> str:
        """What the vocabulary file's library gives with no decoder set: token strings joined by a space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_MODELS: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One model per worker process and path."""
    if path not in _MODELS:
        _MODELS[path] = WordBpe(path)
    return _MODELS[path]


TEXTS_AT_ONCE = 256


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Add [ids (binary, little-endian u32; if ``with_ids``), n_tokens, ids_sha256, decoded_sha256] to ``docs``.

    One narrow pass, no shuffle; ``vocabulary`` must be readable on every executor.
    """
    prepare(docs)
    made = [*([T.StructField("ids", T.BinaryType())] if with_ids else []), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    names = {f.name.lower() for f in made}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + made)
    carried = [f.name for f in kept if f.name != text_col]

    def run(batches):
        model = load(vocabulary)
        for batch in batches:
            text = column_array(batch, text_col)
            for lo in range(0, len(text), TEXTS_AT_ONCE):
                piece = text.slice(lo, TEXTS_AT_ONCE)
                rows = model.encode_batch([t or "" for t in piece.to_pylist()])
                cols = {f: column_array(batch, f).slice(lo, TEXTS_AT_ONCE) for f in carried} | {text_col: piece}
                if with_ids:
                    cols["ids"] = pa.array(rows, pa.binary())
                cols["n_tokens"] = pa.array([len(r) // 4 for r in rows], pa.int64())
                cols["ids_sha256"] = [hashlib.sha256(r).hexdigest() for r in rows]
                cols["decoded_sha256"] = [hashlib.sha256(model.decode(r).encode("utf-8", "surrogatepass")).hexdigest() for r in rows]
                yield pa.RecordBatch.from_pydict({f.name: cols[f.name] for f in schema.fields})

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """Add ``decoded`` (string) to rows with ids; null ids give the empty text."""
    prepare(encoded)
    kept = [f for f in encoded.schema.fields if f.name.lower() != "decoded"]
    schema = T.StructType([*kept, T.StructField("decoded", T.StringType())])

    def run(batches):
        model = load(vocabulary)
        for batch in batches:
            texts = [model.decode(b or b"") for b in column_array(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([column_array(batch, f.name) for f in kept] + [pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
