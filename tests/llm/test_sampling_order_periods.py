"""Importance resampling, sharding and periodic runs: brute force, small and hostile cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from proxlab.llm import periods, queries, resample, shards

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


# ---- op 11 --------------------------------------------------------------------------------------

def brute_features(text, max_n):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i:i + n]).encode() for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, max_n, buckets, percent, min_words, seed):
    own, want = Counter(), Counter()
    rows = []
    for _, t in docs:
        n, f = brute_features(t, max_n)
        rows.append((n, [zlib.crc32(x) % buckets for x in f]))
        own.update(rows[-1][1])
    for t in target:
        want.update(zlib.crc32(x) % buckets for x in brute_features(t, max_n)[1])
    s, t = sum(own.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in own}
    out = []
    for (i, _), (n, f) in zip(docs, rows):
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_brute_force(spark, max_n):
    rng = random.Random(max_n)
    words = ["Alpha", "beta", "GAMMA-ray", "ümlaut", "x1", "it's", "Ä", " z", "tab\tbed", "1.5"]
    docs = [(i * 3 - 20, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "... --"), (1003, "beta " * 5000), (None, "beta x1 " * 9)] + [docs[4]] * 3
    target = ["alpha beta x1", "Ümlaut gamma", None, "beta beta"]
    d = spark.createDataFrame(docs, DOC).repartition(5).withColumn("rank", F.lit("clash")).withColumn("place", F.lit(1))
    t = spark.createDataFrame([(x, 1) for x in target], "text string, weight int")
    got = as_rows(resample.resample(d, t, percent=30, min_words=8, max_n=max_n, buckets=500, seed=7))
    want = sorted(map(tuple, brute_resample(docs, target, max_n, 500, 30, 8, 7)), key=lambda r: tuple((x is None, x or 0) for x in r))
    assert got == want
    ids = {r[0] for r in want if r[5] is not None and r[0] is not None}
    drawn = resample.draw(d, t, percent=30, min_words=8, max_n=max_n, buckets=500, seed=7)
    assert drawn.columns == d.columns and {r.doc_id for r in drawn.collect()} == ids


def test_features_of_pieces_equal_the_whole(monkeypatch):
    rng = random.Random(5)
    text = " ".join("w" * rng.randint(1, 6) + str(rng.randint(0, 9)) for _ in range(400))
    for size in (1, 7, 50, 10_000):
        monkeypatch.setattr(resample, "PIECE_BYTES", size)
        for n in (1, 2, 4):
            parts = list(resample.feature_hashes(text, n))
            assert sum(k for k, _ in parts) == 400
            assert Counter(h for _, p in parts for h in p) == Counter(zlib.crc32(f) for f in brute_features(text, n)[1])


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    some = spark.createDataFrame([(1, "a b c d"), (2, "c d e f")], DOC)
    assert resample.resample(none, some).count() == 0
    got = resample.resample(some, none, percent=100, min_words=1).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2]
    assert {r.doc_id: r.weight for r in got} == {i: w for i, _, _, w, _, _ in brute_resample([(1, "a b c d"), (2, "c d e f")], [], 1, 10_000, 100, 1, 2024)}


# ---- op 12 --------------------------------------------------------------------------------------

@pytest.mark.parametrize("total", [1, 2, 3, 5, 17, 99, 100, 101, 1000])
def test_permutation_and_its_inverse(spark, total):
    rows = spark.range(total).withColumnRenamed("id", "n")
    got = shards.locate(rows, "n", total, 7).toPandas()
    assert sorted(got.slot * 7 + got.shard) == list(range(total))
    back = shards.row_at(spark.createDataFrame(got[["n", "shard", "slot"]]), "shard", "slot", total, 7).toPandas()
    assert (back.n == back.row_number).all()
    if total >= 99:
        assert np.corrcoef(got.n, got.slot * 7 + got.shard)[0, 1] < 0.3
        other = shards.locate(rows, "n", total, 7, seed=99).toPandas()
        assert (got.slot * 7 + got.shard != other.slot * 7 + other.shard).mean() > 0.9


def test_shards_are_even_gapless_and_reproducible(spark, tmp_path):
    rows = [(i, f"t{i}") for i in range(230)] + [(7, "t7")] * 90 + [(None, None), (None, ""), (999, None), (1000, "x " * 60_000)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, DOC).withColumn("shard", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("at", F.lit(2))
    one, two = shards.assign(d.repartition(3), 8), shards.assign(d.repartition(9, "text"), 8)
    a, b = as_rows(one.select("doc_id", "text", "shard", "slot")), as_rows(two.select("doc_id", "text", "shard", "slot"))
    assert a == b and len(a) == len(rows)
    assert sorted(one.columns) == sorted({*d.columns, "row_number", "slot"})
    p = one.toPandas()
    sizes = p.groupby("shard").size()
    assert len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    where = str(tmp_path / "out")
    shards.write(one, where, rows_per_file=10)
    back = spark.read.parquet(where)
    assert back.count() == len(rows)
    assert back.where("piece * 10 > slot OR slot >= piece * 10 + 10").count() == 0
    assert back.withColumn("file", F.input_file_name()).groupBy("shard", "piece").agg(F.countDistinct("file").alias("files")).where("files > 1").count() == 0


def test_shards_of_few_rows(spark):
    none = spark.createDataFrame([], DOC)
    assert shards.assign(none, 4).count() == 0
    one = shards.assign(spark.createDataFrame([(5, "a")], DOC), 4).collect()
    assert [(r.doc_id, r.slot) for r in one] == [(5, 0)]
    with pytest.raises(ValueError, match="shard"):
        shards.assign(none, 0)


def test_shard_query_keeps_its_law(spark):
    got = queries.QUERIES["op12_shards"](spark, SF).toPandas()
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").loc[got.doc_id]
    assert (got["size"].values == [len((t or "").encode()) + 16 for t in docs.text]).all()
    assert (got.text_crc32.values == [zlib.crc32((t or "").encode()) for t in docs.text]).all()
    n = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert n.max() - n.min() <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()


# ---- op 13 --------------------------------------------------------------------------------------

def brute_runs(w, least=12):
    """(start, length, period): for each period, the stretches whose words equal those one period on."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
            i = max(i, s + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(x for i, x in enumerate(w) if i not in gone)


def woven(rng):
    kinds, n, w = rng.choice([1, 2, 2, 3, 5, 60]), rng.choice([0, 5, 12, 13, 40, 90, 200]), []
    while len(w) < n:
        how = rng.random()
        if how < 0.4 and w:
            a = rng.randrange(len(w))
            w += w[a:a + rng.randint(1, 40)] * rng.randint(1, 5)
        elif how < 0.5:
            w += w[::-1][:rng.randint(1, 30)]
        else:
            w += [rng.randrange(kinds) for _ in range(rng.randint(1, 20))]
    return [b"%d" % x for x in w[:n]]


@pytest.mark.parametrize("least", [2, 3, 7, 12, 24])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(120):
        docs = [woven(rng) for _ in range(rng.randint(1, 4))]
        for w, got in zip(docs, periods.runs_of(docs, least), strict=True):
            assert list(map(tuple, got.tolist())) == brute_runs(w, least), b" ".join(w)


def test_touching_surroundings_give_every_period():
    w = [b"b", b"a"] * 12 + [b"a", b"b"] * 12  # a mirror: many odd periods across the middle
    got = list(map(tuple, periods.runs_of([w])[0].tolist()))
    assert got == brute_runs(w) and len({q for _, _, q in got}) > 5


def test_wavelet_tree_answers_range_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(97)
    tree = periods.WaveletTree(values)
    lo = rng.integers(0, 97, 300)
    hi = np.minimum(97, lo + rng.integers(0, 40, 300))
    x = rng.integers(0, 140, 300)
    below = tree.below(lo, hi, x)
    assert below.tolist() == [int((values[a:b] < v).sum()) for a, b, v in zip(lo, hi, x)]
    some = below < hi - lo
    got = tree.pick(lo[some], hi[some], below[some])
    assert got.tolist() == [int(min(u for u in values[a:b] if u >= v)) for a, b, v in zip(lo[some], hi[some], x[some])]


def test_detect_small(spark):
    rng = random.Random(2)
    rows = [(i, b" \t\n".join(woven(rng)).decode(), "k") for i in range(60)]
    rows += [(100, None, "n"), (101, "", "e"), (102, " \n\x0b ", "b"), (103, "a b c " * 8000, "long"), (None, "x y " * 9, "id"), rows[3], rows[3],
             (104, "é é " * 12, "other"), (105, "a " * 11, "short")]
    d = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(4).withColumn("c0", F.lit("kept"))
    got = periods.detect(d).toPandas()
    assert got.columns.tolist() == ["doc_id", "c0", "n_words", "runs", "collapsed"] and (got.c0 == "kept").all()
    have = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.itertuples())
    want = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        runs = [(0, 24000, 3)] if i == 103 else brute_runs(w)
        want.append((-1 if i is None else i, len(w), runs, brute_collapsed(w, runs).decode()))
    assert have == sorted(want)
    assert periods.detect(d.limit(0)).count() == 0


def test_periodic_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries.QUERIES["op13_periodic_runs"](spark, SF).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    some = 0
    for i, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, n)]
        if n > 4000:
            continue  # the loops below are quadratic
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        row = got.loc[i]
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs)).hexdigest()
        if best:
            some += 1
            assert (row.start, row.length, row.period, row.exponent_milli) == (*best, 1000 * best[1] // best[2])
        else:
            assert row[["start", "length", "period", "exponent_milli"]].isna().all()
    assert some > 5
