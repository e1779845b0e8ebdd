"""Benchmark decontamination with an Aho-Corasick automaton (operator 5).

Items and documents are normalized alike (A-Z lowered; words are runs of digits, a-z and non-ASCII
characters, joined by one space).  Every 13 consecutive words of an item, or a whole shorter item,
form a window.  All windows go into one automaton; each document is scanned once, and hits are mapped
back to word numbers and to code-point offsets of the original text.

The items are broadcast.  Their size is checked first: they are dealt into as many blocks as keep each
block's text under ``max_block_bytes``, and every block gets an automaton of its own, so that a worker
holds one bounded automaton at a time.  Benchmarks of ordinary size are one block.

Null or word-less texts have no words: as items they give no window, as documents no hit.  An item
that occurs twice under one id counts once; items with equal text but different ids all count;
documents' rows are judged one by one, so repeated rows give repeated results.  Item ids are taken
as strings; items with a null id can cause hits but are not listed.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, prepare

WINDOW_WORDS = 13
MAX_BLOCK_BYTES = 32 << 20
#: A-Z to a-z; ASCII characters that are not letters or digits to a space
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

HIT_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("items", T.ArrayType(T.StringType())),
              T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))]


def fold(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def windows(text: str, size: int) -> set[bytes]:
    w = fold(text)
    if not w:
        return set()
    return {b" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}


def automaton(items: list[tuple[str | None, str]], size: int):
    owners: dict[bytes, set] = {}
    for item, text in items:
        for w in windows(text, size):
            owners.setdefault(w, set()).add(item)
    a = ahocorasick.Automaton()
    for w, ids in owners.items():
        a.add_word(f" {w.decode('utf-8', 'surrogatepass')} ", (w.count(b" ") + 1, ids))
    if len(a):
        a.make_automaton()
    return a


def original_spans(text: str, hit: np.ndarray) -> list[list[int]]:
    """[start, end) code points in ``text`` of each run of hit words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.array([c != 32 for c in FOLD], bool)
    inside = np.ones(len(points), bool)
    low = points < 128
    inside[low] = table[points[low]]
    pad = np.r_[False, inside, False].astype(np.int8)
    change = np.diff(pad)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    run = np.diff(np.r_[False, hit, False].astype(np.int8))
    return [[int(starts[a]), int(ends[b - 1])] for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)]


def scan(text: str | None, auto) -> tuple[int, np.ndarray | None, set]:
    """(words, mask of hit words or None, items) of one text."""
    words = fold(text or "")
    if not words or not len(auto):
        return len(words), None, set()
    joined = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    found = list(auto.iter(joined))
    if not found:
        return len(words), None, set()
    # number of the word that ends before each space
    at = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32
    number = np.cumsum(at) - 1
    step = np.zeros(len(words) + 1, np.int64)
    items: set = set()
    for end, (size, ids) in found:
        last = number[end]
        step[last - size] += 1
        step[last] -= 1
        items |= ids
    return len(words), np.cumsum(step[:-1]) > 0, items


def item_blocks(items: DataFrame, id_col: str, text_col: str, max_block_bytes: int) -> list[list[tuple]]:
    """The items, dealt by hash into blocks of bounded text; one block at a time is on the driver."""
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = int(size // max_block_bytes) + 1
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r.i, r.t) for r in part.collect()]


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
         window_words: int = WINDOW_WORDS, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """``docs`` with [n_words, n_hit, items, spans] added (replacing columns of those names).

    One narrow pass, no shuffle: a document meets the blocks' automata in turn within its task.
    """
    prepare(docs)
    sc = docs.sparkSession.sparkContext
    names = {f.name.lower() for f in HIT_FIELDS}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + HIT_FIELDS)
    base = docs.select(*[docs[f"`{f.name}`"] for f in kept])
    blocks = [sc.broadcast(b) for b in item_blocks(items, item_id, item_text, max_block_bytes)]

    def run(batches):
        # a block's automaton is built once per task; with several blocks a document meets them in turn
        autos = [automaton(b.value, window_words) for b in blocks] if len(blocks) == 1 else None
        for batch in batches:
            texts = column_array(batch, text_col)
            total: list = [None] * len(texts)
            for b in range(len(blocks)):
                auto = autos[0] if autos else automaton(blocks[b].value, window_words)
                for i in range(len(texts)):
                    n, mask, ids = scan(texts[i].as_py(), auto)
                    if total[i] is None:
                        total[i] = [n, mask, set(ids)]
                    elif mask is not None:
                        total[i][1] = mask if total[i][1] is None else total[i][1] | mask
                        total[i][2] |= ids
            spans = [[] if m is None else original_spans(texts[i].as_py(), m) for i, (_, m, _) in enumerate(total)]
            yield pa.RecordBatch.from_arrays(
                [column_array(batch, f.name) for f in kept]
                + [pa.array([n for n, _, _ in total], pa.int64()), pa.array([0 if m is None else int(m.sum()) for _, m, _ in total], pa.int64()),
                   pa.array([sorted(i for i in ids if i is not None) for _, _, ids in total], pa.list_(pa.string())),
                   pa.array(spans, pa.list_(pa.list_(pa.int32())))],
                names=schema.names)

    return base.mapInArrow(run, schema)


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words", part: int = 20):
    """At least one word in ``part`` is hit."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * part >= F.col(n_words))
