"""Small cases of every corpus operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proxlab.llm import bpe, common, decontaminate, langid, lines, lmscore, pii, queries, simhash, substring, topk, toxicity
from test_corpus_queries import brute_components, brute_fingerprint

WORDS = [f"w{i}" for i in range(40)]
DOC = "doc_id long, text string"


def text(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


# ---- common -------------------------------------------------------------------------------------

def test_word_spans_and_hashes():
    rows = ["a bb  ccc", "", " x\ty\n", "bb"]
    raw = [r.encode() for r in rows]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0, *map(len, raw)])
    s, e, n = common.word_spans(buf, off)
    assert [buf[a:b].tobytes().decode() for a, b in zip(s, e)] == ["a", "bb", "ccc", "x", "y", "bb"]
    assert n.tolist() == [3, 0, 2, 1]
    h = common.word_hashes(buf, s, e)
    assert h[1] == h[5] and len(set(h.tolist())) == 5


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(-5, -9), (7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, **{i: 100 for i in range(101, 160)}, -5: -9}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- op 1 ---------------------------------------------------------------------------------------

def test_toxicity_small(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        w = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["vilest", "vilely", "rotten"])
        docs.append((i, " ".join(w), 1, "x"))
        labels.append((i, int(bad)))
    docs += [(1000, None, 1, None), (1001, "", 1, "y"), (None, "w1 rotten", 1, "z"), (0, docs[0][1], 1, "again"), (2000, "w1 w2 " * 30_000 + "vilest", 1, "")]
    labels += [(4, None), (None, 1), (99999, 1), (5, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted int, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    got = toxicity.score(d, model).toPandas()
    assert len(got) == len(docs) and got.columns.tolist() == ["doc_id", "text", "score", "predicted"]
    first = got[got.doc_id < 300].drop_duplicates("doc_id").set_index("doc_id")
    truth = pd.Series({i: int(i % 5 == 0) for i in range(300)})
    assert (first.predicted.sort_index() == truth).mean() > 0.97
    empty = got[got.doc_id.isin([1000, 1001])].score
    assert np.allclose(empty, model.value.base) and (got.doc_id == 0).sum() == 2
    # no label, or labels of one class only: the base rate
    for some in (lab.limit(0), lab.where("toxic = 0")):
        assert set(toxicity.score(d, toxicity.fit(d, some)).toPandas().score) == {0.0}
    assert toxicity.score(d.limit(0), model).count() == 0
    assert toxicity.fit(d.limit(0), lab).value.weights is None


def test_toxicity_tables_hold_every_count(spark):
    # "rare" always follows "very" in one class; most bigrams and contexts occur once
    rows = [("very rare", 1)] * 5 + [(f"a{i} b{i} a c{i}", i % 2) for i in range(20)]
    pairs = toxicity.count_pairs(spark.createDataFrame(rows, "text string, toxic int"), "text")
    units, contexts, bigrams, _ = toxicity.count_models(pairs)
    firsts, seconds, both = set(), set(), set()
    for t, _ in rows:
        raw = np.frombuffer(t.encode(), np.uint8)
        (words, *_), _ = toxicity.words_of(raw, np.array([0, len(raw)]))
        firsts |= set(words[:-1].tolist())
        seconds |= set(words[1:].tolist())
        both |= set(toxicity.pair_keys(words[:-1], words[1:]).tolist())
    assert [set(x[0].tolist()) for x in (units[0], contexts, bigrams)] == [seconds, firsts, both]


# ---- op 2 ---------------------------------------------------------------------------------------

def brute_repeats(rows, window):
    docs = sorted({(i, t) for i, t in rows if i is not None})
    seen, gone = {}, {}
    for i, t in docs:
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            if tuple(w[s:s + window]) in seen:
                gone.setdefault((i, t), set()).update(range(s, s + window))
            seen.setdefault(tuple(w[s:s + window]), (i, s))
    out = []
    for i, t in rows:
        w = (t or "").split()
        g = gone.get((i, t), set())
        out.append((i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,core", [(6, 3), (6, 6), (5, 1), (20, 10)])
def test_repeats_equal_brute_force(spark, window, core):
    rng = random.Random(window * 10 + core)
    passage = [text(rng, rng.randint(window, 3 * window), WORDS) for _ in range(4)]
    rows = []
    for i in range(120):
        parts = [text(rng, rng.randint(0, 15), WORDS[:3] if i % 7 == 0 else WORDS)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passage), text(rng, rng.randint(0, 9))]
        rows.append((i * 3 - 50, "  ".join(parts)))
    rows += [(900, rows[5][1]), (901, None), (902, ""), (903, "a " * 80), (904, "a b " * 40), (905, text(rng, 4)), rows[7], (None, passage[0]), (None, passage[0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOC).repartition(5).withColumn("tag", F.lit("clash")).withColumn("m", F.lit(1))
    got = [tuple(r) for r in substring.remove_repeats(df, window=window, core=core).select("doc_id", "n_words", "n_removed", "text").collect()]
    assert sorted(got, key=str) == brute_repeats(rows, window)


def test_repeats_of_a_frequent_passage_and_spans(spark):
    rng = random.Random(1)
    passage = text(rng, 30)
    rows = [(i, f"{text(rng, 8, [f'u{i}x{k}' for k in range(50)])} {passage} {text(rng, 3, [f'v{i}x{k}' for k in range(50)])}") for i in range(400)]
    out = substring.remove_repeats(spark.createDataFrame(rows, DOC).repartition(7), window=20).toPandas().set_index("doc_id")
    assert out.n_removed.tolist().count(30) == 399 and out.loc[0].n_removed == 0
    assert [list(s) for s in out.loc[9].spans] == [[8, 38]]
    assert substring.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


# ---- op 3 ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("segments,block", [(None, 4096), (4, 7), (2, 50), (1, 4096)])
def test_near_links_equal_brute_force(spark, segments, block):
    rng = random.Random(segments or 9)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base[:30]:
        for _ in range(6):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in common.components(simhash.near_links(df, segments=segments, block=block, sample=64)).collect()}
    assert [roots.get(s, s) for s in signed] == brute_components(fps, signed)


def test_near_duplicates_small(spark):
    rng = random.Random(5)
    t = text(rng, 200)
    rows = [(4, t), (2, t), (2, t), (9, t.upper()), (11, text(rng, 200)), (20, None), (21, ""), (22, " \n"), (30, "one two"), (31, "One  two"), (None, t), (None, None)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, fp int, k string")
    got = sorted(((r.doc_id, r.component_id, r.fp & simhash_mask) for r in simhash.near_duplicates(df).collect()), key=str)
    want = {4: 2, 2: 2, 9: 2, 11: 11, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30, None: None}
    assert got == sorted(((i, want[i], brute_fingerprint(x)) for i, x in rows), key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    long = "alpha beta gamma delta " * 60_000
    assert simhash.fingerprint(long) == brute_fingerprint(long)


simhash_mask = (1 << 64) - 1


# ---- op 4 ---------------------------------------------------------------------------------------

def test_pii_learns_contexts(spark):
    rows = [(i, f"noise {i} call me at +1 (212) 555-{1000 + i} now") for i in range(12)]
    rows += [(100, "please call me at 212 555 7788 now"), (101, "we paid 212 555 7788 there"), (102, None), (103, ""), (100, "please call me at 212 555 7788 now")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, row string")
    got = pii.extract(df).withColumn("t", pii.as_text(F.col("found"))).withColumn("b", pii.as_text(F.col("base"))).toPandas()
    by = got.set_index("doc_id")
    assert by.loc[100].t.tolist() == ["phone:18:30"] * 2
    assert by.loc[101].t == "" and by.loc[102].b == "" and by.loc[103].t == ""
    assert by.loc[3].b == "phone:19:36"
    assert pii.extract(df.limit(0)).count() == 0


def test_pii_finds_in_a_context_of_few_seeds(spark):
    rows = [(i, f"q{i} ring us on +1 (212) 555-{1000 + i} now") for i in range(8)] + [(100 + i, f"q{i} ring us on 212 555 {7000 + i} now") for i in range(8)]
    # as many addresses as numbers follow "via": it says nothing
    rows += [(200 + i, f"r{i} sent via +1 (212) 555-{2000 + i} or") for i in range(6)] + [(300 + i, f"r{i} sent via me{i}@host.org or") for i in range(6)]
    rows += [(400, "r sent via 212 555 8000 or")]
    got = pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", F.size("found").alias("n")).collect()
    assert {r.doc_id for r in got if r.n} == {100 + i for i in range(8)}


def test_pii_long_names_and_instances_stay_whole():
    name = "a" * 100
    assert pii.loose_emails(f"x {name} at host dot org {name}@b") == [(2, 118), (119, 221)]
    assert pii.normal_instance("a" * 300) != pii.normal_instance("a" * 301)


@pytest.mark.parametrize("t", ["a@b.c@d.e x_y@z.w", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1111-1", "+1 234 567 89() +12",
                               "9" * 5000, "a" * 50_000 + "@", "@.@a@b.cc@", "x@y.z.", "+" * 2000 + "1" * 9])
def test_pii_base_forms(t):
    from test_corpus_queries import brute_base

    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(t)] == brute_base(t if len(t) < 10_000 else "")


# ---- op 5 ---------------------------------------------------------------------------------------

def test_decontamination_small(spark):
    from test_corpus_queries import brute_hits

    rng = random.Random(2)
    items = [("a", text(rng, 20)), ("b", "Short One!"), ("c", None), ("d", " ?! "), ("b", "Short One!"), ("e", "short one"), (None, "É ß1")]
    docs = [(1, f"x, y {items[0][1].upper().replace(' ', '; ')} z"), (2, "a SHORT-one b"), (3, "shorty one"), (4, None), (5, ""), (6, "q " * 50_000 + "short one"), (2, "a SHORT-one b")]
    d = spark.createDataFrame([(*r, 0, "i") for r in docs], "doc_id long, text string, n_hit int, items string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = brute_hits(docs, [i for i in items if i[0]])
    for size in (1 << 20, 16):  # one block of items, and several
        got = decontaminate.find(d, b, max_block_bytes=size).withColumn("bad", decontaminate.contaminated()).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_words, r.n_hit, len(r["items"]), r.bad) == (*want[r.doc_id][:3], want[r.doc_id][4])
    two = decontaminate.find(d, b).where("doc_id = 2").first()
    assert [docs[1][1][s:e] for s, e in two.spans] == ["SHORT-one"]
    none = decontaminate.find(d, b.limit(0)).collect()
    assert all(r.n_hit == 0 for r in none) and decontaminate.find(d.limit(0), b).count() == 0


# ---- op 6 ---------------------------------------------------------------------------------------

def test_line_dedup_small(spark):
    rows = [(i, "h", f"Menu \nbody {i}\n\n Menu") for i in range(10)] + [(20, "h", None), (21, "h", ""), (22, None, "Menu\nown"), (23, "g", "Menu"), (9, "h", "Menu \nbody 9\n\n Menu")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "page_id long, host string, text string, n_lines int")
    got = {(r.page_id, r.host): (r.text, r.n_lines, r.n_dropped) for r in lines.drop_boilerplate(df, ratio=0.5).collect()}
    assert got[3, "h"] == ("body 3\n", 3, 2)
    assert got[20, "h"] == (None, 0, 0) and got[21, "h"] == ("", 0, 0)
    assert got[22, None] == ("Menu\nown", 2, 0) and got[23, "g"] == ("Menu", 1, 0)
    assert lines.drop_boilerplate(df, ratio=0.5).count() == len(rows)
    assert lines.drop_boilerplate(df, ratio=1.0).where("n_dropped > 0").count() == 0
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, f"h{i % 3}", f"top {i % 3}\nbody {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    a = lines.drop_boilerplate(df, ratio=0.5).toPandas().sort_values("page_id").values.tolist()
    monkeypatch.setattr(lines, "BROADCAST_KEYS", -1)
    assert lines.drop_boilerplate(df, ratio=0.5).toPandas().sort_values("page_id").values.tolist() == a
    assert a[0][2] == "body 0"


@pytest.mark.parametrize("others, copies", [(60, 30), (0, 4)])
def test_pipeline_keeps_one_of_a_large_copy_group(spark, others, copies):
    rng = random.Random(9)
    copied = text(rng, 30, [f"c{i}" for i in range(99)]) + "\n" + text(rng, 30, [f"d{i}" for i in range(99)])
    rows = [(i, "Menu\n" + text(rng, 40, [f"o{i}x{j}" for j in range(99)]), "s", 0) for i in range(others)]
    rows += [(1000 + i, copied, "s", 0) for i in range(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    left = corpus_pipeline.drop_boilerplate_lines(spark, docs, "")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_near_duplicates(spark, left, "").collect()}
    # the first bearer keeps the line
    assert got == {**{i: t if i == 0 else t.removeprefix("Menu\n") for i, t, *_ in rows[:others]}, 1000: copied}


def test_pipeline_keeps_the_text_that_near_copies_share(spark):
    rng = random.Random(11)
    shared = [text(rng, 12, [f"s{i}x{j}" for j in range(50)]) for i in range(10)]
    rows = [(i, text(rng, 40, [f"o{i}x{j}" for j in range(99)]), "s", 0) for i in range(40)]
    rows += [(100 + i, "\n".join([*shared, f"tail {i}"]), "s", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.drop_boilerplate_lines(spark, docs, ""), "").collect()
    whole = [r for r in kept if all(x in r.text for x in shared)]
    assert [(r.doc_id, r.text, r.n_chars) for r in whole] == [(100, rows[40][1], len(rows[40][1]))]
    assert {r.doc_id: r.text for r in kept if r.doc_id < 100} == {i: t for i, t, *_ in rows[:40]}


def test_line_dedup_keeps_first_bearers(spark):
    rows = [(5, "h", "Menu\nfive"), (3, "h", "Menu\nthree"), (3, "h", "Menu\nthree"), (8, "h", "three\nMenu"), (9, "h", "Menu\nnine"), (None, "h", "Menu\nnone"),
            (7, None, "Menu"), (10, "h", None), (11, "h", "eleven")]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("page", F.lit(0)).withColumn("first", F.lit("x"))
    got = lines.drop_boilerplate(df, ratio=0.2, min_pages=2, once=True, keep_first="page_id")
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted(((r.page_id, r.text, r.n_dropped) for r in got.collect()), key=str) == sorted([
        (5, "five", 1), (3, "Menu\nthree", 0), (3, "Menu\nthree", 0), (8, "", 2), (9, "nine", 1), (None, "none", 1), (7, "Menu", 0), (10, None, 0), (11, "eleven", 0)], key=str)


STAGE_ROWS = [(1, "plain words of no harm", "s"), (1, "plain words of no harm", "s"), (2, None, None), (3, "", "s"), (None, "no id here at all", "s"),
              (4, "w " * 40_000 + "end", "t"), (5, "plain words of no harm", "s"), (1, "another text under one id", "s")]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stages_on_hostile_rows(spark, stage):
    sf = "/root/testdata/sf0.001"
    docs = spark.createDataFrame([(*r, "en", 7, 0.5, "p", 1) for r in STAGE_ROWS],
                                 "doc_id long, text string, source string, lang string, n_chars long, score double, items string, rows int")
    out = stage(spark, docs, sf).toPandas()
    none = stage(spark, docs.limit(0), sf)
    assert none.count() == 0 and none.columns == out.columns.tolist()
    ids = sorted(-1 if pd.isna(i) else int(i) for i in out.doc_id)
    if stage is corpus_pipeline.encode_tokens:
        assert ids == [-1, 1, 1, 1, 2, 3, 4, 5]
        assert (out[out.doc_id.isin([2, 3])].n_tokens == 0).all()
        return
    assert out.columns.tolist() == docs.columns
    assert (out["score"] == 0.5).all() and (out["items"] == "p").all() and (out["rows"] == 1).all() and (out.lang == "en").all()
    if stage is corpus_pipeline.drop_near_duplicates:
        # 1 and 5 are copies, 2 and 3 both have no word; of the rows of doc_id 1 one stays
        assert ids == [-1, 1, 2, 4]
    else:
        assert ids == [-1, 1, 1, 1, 2, 3, 4, 5]
        assert out.set_index("doc_id").text[4.0].startswith("w w")


# ---- op 7 ---------------------------------------------------------------------------------------

def test_language_small(spark):
    rng = random.Random(4)
    sets = {"en": ["the", "with", "house"], "de": ["und", "nicht", "haus"], "fr": ["avec", "maison", "être"], "xx": ["qoph", "zayin"]}
    rows = [(i, text(rng, 30, sets[lang]), lang) for i, lang in enumerate(list(sets) * 30)]
    rows += [(900, None, "en"), (901, "123 !?", "en"), (902, "the house", None), (903, "", None), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, score int")
    got = langid.predict(df, langid.fit(df)).toPandas()
    assert len(got) == len(rows)
    known = got[got.doc_id < 900]
    assert (known.lang == known.lang_pred).all()
    assert got[got.doc_id.isin([900, 901, 903])].lang_pred.tolist() == ["und"] * 3
    assert got[got.doc_id == 902].lang_pred.item() == "en"
    none = langid.predict(df, langid.fit(df.where("lang IS NULL"))).toPandas()
    assert set(none.lang_pred) == {"und"}
    one = langid.predict(df, langid.fit(df.where("lang = 'de'"))).where("doc_id < 900").toPandas()
    assert set(one.lang_pred) == {"de"}
    assert langid.predict(df.limit(0), langid.fit(df)).count() == 0


# ---- op 8 ---------------------------------------------------------------------------------------

def test_bpe_odd_texts(spark):
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    lib = Tokenizer.from_file(path)
    rng = random.Random(8)
    letters = "aab'sStre \n\t\x1c\x85\xa0ÉéßΣσΩİ1234!?…日本語🙂́‍"
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    odd += ["a<|endoftext|>b <|startoftext|>", "it's we'll I'D", "x" * 20_000, "aaaa" * 500, "", None, "étÉ"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(odd)], "doc_id long, text string, n_tokens string")
    coded = bpe.encode(df, path)
    got = {r.doc_id: r for r in bpe.decode(coded, path).collect()}
    assert len(got) == len(odd) and coded.columns == ["doc_id", "text", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    for i, t in enumerate(odd):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, repr(t)
        assert got[i].decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0), path).count() == 0


# ---- op 9 ---------------------------------------------------------------------------------------

def brute_top(rows, k, is_query):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, qv in ok:
        if is_query(q):
            s = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in ok if i != q and len(v) == len(qv)))[:k]
            out += [(q, r + 1, i, -score) for r, (score, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=8) * np.exp(spread * rng.normal())).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    rows += [(2000, None), (2010, [1.0] * 7 + [None]), (2020, [float("nan")] * 8), (2030, [float("inf")] * 8), (2040, [0.0] * 8), (2050, [1.0, 2.0]), (2051, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("norm", F.lit("x"))
    got = topk.search(df, F.col("id") % 10 == 0, k=5, block_rows=50, query_rows=20)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 5, lambda q: q % 10 == 0)
    assert topk.search(df.limit(0), F.col("id") % 10 == 0).count() == 0


def test_topk_large_numbers():
    q, c = np.array([[2**40, 3]]), np.array([[2**40, 5], [7, 1]])
    assert topk.products(q, c).tolist() == [[2**80 + 15, 7 * 2**40 + 3]]


# ---- op 10 --------------------------------------------------------------------------------------

def brute_scores(texts, order, alpha):
    from collections import Counter

    docs = [(t or "").encode().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i:i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    own = [grams(w) for w in docs]
    every = sum(own, Counter())
    total = sum(map(len, docs))
    out = []
    for w, mine in zip(docs, own, strict=True):
        c = lambda g: every[g] - mine[g]  # noqa: B023,E731
        rest, sum_ = total - len(w), 0.0
        for i in range(len(w)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1:i + 1])
                if c(g) > 0:
                    sum_ += np.log(c(g) / (c(g[:-1]) if k > 1 else rest))
                    break
                sum_ += np.log(alpha)
            else:
                sum_ -= np.log(rest + 1)
        out.append(sum_)
    return out


@pytest.mark.parametrize("order,block", [(1, 1 << 20), (2, 400), (3, 900)])
def test_lm_scores_equal_brute_force(spark, order, block):
    rng = random.Random(order)
    texts = [text(rng, rng.randint(0, 40)) for _ in range(60)] + [None, "", "unique", "w1", "w1", text(rng, 3000)]
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, part int, block string")
    got = lmscore.score(df, order=order, block_bytes=block, range_bytes=block).toPandas().sort_values("doc_id")
    assert np.allclose(got.logprob, brute_scores(texts, order, 0.4))
    assert got.n_words.tolist() == [len((t or "").split()) for t in texts]
    assert got[got.n_words == 0].score.isna().all()
    assert (got[[f"n_order{k}" for k in range(1, order + 1)]].sum(axis=1) + got.n_unseen == got.n_words).all()
    assert lmscore.score(df.limit(0)).count() == 0
