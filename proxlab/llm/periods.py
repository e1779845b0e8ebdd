"""Periodic runs of words in whole documents (operator 13), by internal pattern matching.

A run is a stretch of consecutive words [start, start + length) whose smallest period is ``period`` (words
that far apart are identical), of at least max(``min_length``, 2 * period) words, which no neighbouring word
extends with that period.  Collapsing a document drops each word that some run holds after its first period.

Method, per slice of documents laid in one flat sequence of word numbers (a word of another document is another
number, and a unique separator follows each document, so nothing matches across documents):

* Prefix doubling names the blocks of 1, 2, 4, ... words that begin at each place (equal blocks, equal names) until
  all names differ; the names are then the suffix array.  Documents in which no block of the least size asked for
  below occurs twice leave early: they have no run.
* In a run of period p the words [start, start + length - p) occur again p further.  That stretch has at least
  max(min_length / 2, p) words, so it holds a dyadic block (2^k words at a multiple of the block's stride), whose
  occurrence p words further lies in a neighbouring window of length proportional to the block.  A block's
  occurrences are an interval of the suffix array; a wavelet tree over that array answers range
  successor: the next occurrence at or after a place.
* Occurrences that begin within one block's length form an arithmetic progression, whose difference
  is the block's own period once there are three.  One or two occurrences are candidate periods by themselves.  Of a
  longer progression the difference is one; further ones follow from where the block's periodic surroundings end:
  they must end p words further too (on the right or on the left), unless the surroundings of both places touch, and
  only then is every term a candidate.
* A candidate is extended to both sides by the block names (longest common extensions); stretches
  that are long enough are runs, and of equal stretches the smallest period counts.

All steps are numpy passes over the slice.  A document is never cut; a slice holds about ``SLICE_WORDS`` words, or one
longer document, and takes some 4 log2(its words) + 8 log2(its longest repeat) bytes a word beside the words.

Words are runs of bytes other than space and \\t\\n\\v\\f\\r.  A null or empty text has no words and no runs, and
its collapsed text is empty.  Repeated rows give the same result each.  Columns called ``n_words``, ``runs`` or
``collapsed`` are replaced, others kept.  Runs are listed by start, then period.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_array, prepare

MIN_LENGTH = 12
SLICE_WORDS = 1 << 17


class BlockNames:
    """Names of the blocks of 2^k words at every place, k = 0, 1, ..., until every block is unique.

    ``names[k][i]`` is the number of suffixes that sort before the block at i, so that equal blocks are
    the interval names[k][i] .. names[k][i] + (their number) of the suffix array.  Place n stands for the end.
    ``repeated[k]`` holds (places, numbers of equal blocks) of the blocks that occur more than once.
    """

    def __init__(self, ids: np.ndarray, most: int | None = None):
        n = len(ids)
        size = np.bincount(ids)
        first = np.cumsum(size) - size
        name = np.full(n + 1, -1, np.int64)
        name[:n] = first[ids]
        at = np.flatnonzero(size[ids] > 1)
        self.n, self.names, self.repeated = n, [name], [(at, size[ids[at]])]
        step = 1
        while len(at) and (most is None or step < most):
            key = name[at] * (n + 1) + name[np.minimum(at + step, n)] + 1
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            old = name[at]
            index = np.arange(len(at))
            group = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], index, 0))
            block = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], index, 0))
            name = name.copy()
            name[at] = old + group - block
            size = np.bincount(group, minlength=len(at))[group]
            at, size = at[size > 1], size[size > 1]
            self.names.append(name)
            self.repeated.append((at, size))
            step *= 2

    def suffix_array(self) -> np.ndarray:
        out = np.empty(self.n, np.int64)
        out[self.names[-1][:-1]] = np.arange(self.n)
        return out

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that begins at x and at y, x < y."""
        x, y = x.copy(), y.copy()
        from_ = x.copy()
        for k in range(len(self.names) - 2, -1, -1):
            name = self.names[k]
            step = (name[x] == name[y]).astype(np.int64) << k
            x += step
            y += step
        return x - from_

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before x and before y, x < y."""
        x, y = x.copy(), y.copy()
        from_ = x.copy()
        for k in range(len(self.names) - 2, -1, -1):
            name, size = self.names[k], 1 << k
            step = ((x >= size) & (name[np.maximum(x - size, 0)] == name[np.maximum(y - size, 0)])).astype(np.int64) << k
            x -= step
            y -= step
        return from_ - x


class WaveletTree:
    """Wavelet tree (levels as bit vectors, highest bit first) over a permutation of 0 .. n - 1."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = max(1, int(n - 1).bit_length()) if n else 1
        self.zeros = []  # per level: zeros among the first i values
        for b in range(self.bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            count = np.zeros(n + 1, np.int32)
            np.cumsum(~one, out=count[1:])
            self.zeros.append(count)
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are under x."""
        found = np.zeros(len(lo), np.int64)
        over = x >= 1 << self.bits
        found[over] = (hi - lo)[over]
        lo, hi, x = lo.copy(), np.where(over, lo, hi), np.where(over, 0, x)
        for level, count in enumerate(self.zeros):
            a, b, total = count[lo], count[hi], count[-1]
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            found += np.where(one, b - a, 0)
            lo = np.where(one, total + lo - a, a)
            hi = np.where(one, total + hi - b, b)
        return found

    def pick(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of values[lo:hi]; with k = below(lo, hi, x) the successor of x."""
        out = np.zeros(len(lo), np.int64)
        k = k.copy()
        for level, count in enumerate(self.zeros):
            a, b, total = count[lo], count[hi], count[-1]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            out |= one.astype(np.int64) << (self.bits - 1 - level)
            lo = np.where(one, total + lo - a, a)
            hi = np.where(one, total + hi - b, b)
        return out


def power_under(x: int) -> int:
    return 1 << (int(x).bit_length() - 1)


def candidates(blocks: BlockNames, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): places of dyadic blocks and distances at which a run may repeat them."""
    half = -(-min_length // 2)
    base = power_under(half)
    tree = None
    places, periods = [], []
    for k in range(base.bit_length() - 1, len(blocks.names)):
        size = 1 << k
        stride = power_under(half - base + 1) if size == base else size
        at, equal = blocks.repeated[k]
        aligned = at % stride == 0
        at, equal = at[aligned], equal[aligned]
        if not len(at):
            continue
        if tree is None:
            tree = WaveletTree(blocks.suffix_array())
        lo = blocks.names[k][at]
        hi = lo + equal
        least, most = (1 if size == base else 2 * size - 1), 4 * size - 2
        under = tree.below(lo, hi, at + least)
        for near in range(least, most + 1, size):
            end = tree.below(lo, hi, at + min(near + size, most + 1))
            some = end > under
            b, l, h, c, m = at[some], lo[some], hi[some], under[some], (end - under)[some]
            under = end
            if not len(b):
                continue
            first = tree.pick(l, h, c)
            places.append(b)
            periods.append(first - b)
            more = m > 1
            b, l, h, c, m, first = (x[more] for x in (b, l, h, c, m, first))
            if not len(b):
                continue
            second = tree.pick(l, h, c + 1)
            two = m == 2
            places += [b[two], b[~two]]
            periods += [(second - b)[two], (second - first)[~two]]
            b, m, first, d = b[~two], m[~two], first[~two], (second - first)[~two]
            # a progression of three and more: its difference is the period of the block and of its surroundings
            end_b = b + d + blocks.right(b, b + d)
            apart = end_b < first + size  # else both lie in the same surroundings
            b, m, first, d, end_b = (x[apart] for x in (b, m, first, d, end_b))
            if not len(b):
                continue
            end_y = first + d + blocks.right(first, first + d)
            start_b, start_y = b - blocks.left(b, b + d), first - blocks.left(first, first + d)
            places += [b, b]
            periods += [end_y - end_b, start_y - start_b]
            touch = start_y <= end_b
            b, m, first, d = b[touch], m[touch], first[touch], d[touch]
            term = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            places.append(np.repeat(b, m))
            periods.append(np.repeat(first - b, m) + term * np.repeat(d, m))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, period = np.concatenate(places), np.concatenate(periods)
    good = (period > 0) & (place + period < blocks.n)
    both = np.unique(place[good] * (blocks.n + 1) + period[good])
    return both // (blocks.n + 1), both % (blocks.n + 1)


def find_runs(ids: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a sequence of small numbers, by start, then period."""
    z = np.zeros(0, np.int64)
    if len(ids) < min_length:
        return z, z, z
    blocks = BlockNames(ids)
    place, period = candidates(blocks, min_length)
    start = place - blocks.left(place, place + period)
    length = place + period + blocks.right(place, place + period) - start
    long = length >= np.maximum(min_length, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def number_words(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words of all documents with a separator after each, place of each document)."""
    ids, begin, base = [], [], 0
    for words in docs:
        seen: dict[bytes, int] = {}
        begin.append(len(ids))
        ids += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
        ids.append(base)
        base += 1
    begin.append(len(ids))
    return np.array(ids, np.int64), np.array(begin, np.int64)


def runs_of(docs: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Per document its runs as rows (start, length, period)."""
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(docs)
    ids, begin = number_words(docs)
    early = BlockNames(ids, power_under(-(-min_length // 2)))
    held = np.unique(np.searchsorted(begin, early.repeated[-1][0], side="right") - 1).tolist() if early.repeated else []
    if not held:
        return out
    del early
    if len(held) < len(docs):
        ids, begin = number_words([docs[i] for i in held])
    start, length, period = find_runs(ids, min_length)
    of = np.searchsorted(begin, start, side="right") - 1
    rows = np.stack([start - begin[of], length, period], axis=1)
    cut = np.searchsorted(of, np.arange(len(held) + 1))
    for k, i in enumerate(held):
        out[i] = rows[cut[k]:cut[k + 1]]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


def detect(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``docs`` without its text and with n_words, runs (array of start, length, period) and collapsed (text)."""
    prepare(docs)
    made = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())]
    taken = {text_col.lower(), *(f.name for f in made)}
    kept = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*kept, *made])
    run_type = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))

    def result(words: list[list[bytes]]):
        found = runs_of(words, min_length)
        ends = np.cumsum([0, *map(len, found)])
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        parts = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type.value_type))
        texts = [b" ".join(compress(w, kept_words(len(w), r).tolist()) if len(r) else w) for w, r in zip(words, found, strict=True)]
        return [pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts).cast(run_type),
                pa.array(texts, pa.binary()).cast(pa.string())]

    def run(batches):
        for batch in batches:
            words, lo, size = [], 0, 0
            texts = column_array(batch, "_text")
            for i, t in enumerate(texts):
                text = t.as_py()
                words.append(text.encode().split() if text else [])
                size += len(words[-1]) + 1
                if size >= SLICE_WORDS or i == len(texts) - 1:
                    part = batch.slice(lo, len(words))
                    yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(kept))), *result(words)], names=schema.names)
                    words, lo, size = [], i + 1, 0

    narrow = docs.select(*[docs[f"`{f.name}`"].alias(f"c{i}") for i, f in enumerate(kept)], docs[f"`{text_col}`"].cast("string").alias("_text"))
    return narrow.mapInArrow(run, schema)


def as_lines(runs) -> F.Column:
    """`start,length,period` and a line feed for each run."""
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
