"""Registered queries of the corpus operators against DuckDB SQL or brute force on the smallest tables."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from proxlab.llm import queries
from proxlab.plans.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    result = compare(queries.QUERIES[name](spark, SF), queries.ORACLES[name], duck(SF))
    assert result["match"], result


def brute_fingerprint(text, words=4):
    w = [x for x in SPACE.split((text or "").encode().lower()) if x]
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(fps)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low[find(i)] for i in range(len(fps))]


def test_simhash(spark, documents):
    got = queries.QUERIES["op3_simhash"](spark, SF).toPandas().set_index("doc_id").loc[documents.doc_id]
    fps = [brute_fingerprint(t) for t in documents.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == brute_components(fps, documents.doc_id.tolist())


def test_toxicity_contract(spark, documents):
    got = queries.QUERIES["op1_toxicity"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(documents.doc_id)
    assert got.held_out.tolist() == [crc(i, 4) == 2 for i in got.doc_id]
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()


def test_toxicity_separates_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.QUERIES["op1_toxicity"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    rank, pos = held.score.rank(), (held.toxic == 1)
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.9
    assert held[held.toxic == 0].predicted.mean() < 0.06


def test_language_contract_and_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op7_langid"](spark, sf).toPandas().merge(docs, on="doc_id")
    assert got.held_out.tolist() == [crc(i, 3) == 1 for i in got.doc_id]
    assert got.score.between(0, 1).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_base(text):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, form in forms.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                  "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = queries.QUERIES["op4_pii"](spark, sf).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        base = brute_base(docs.text[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (r.doc_id, joined, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        assert set(joined.split(",")) <= set(r.spans.split(","))


def words13(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words13(text)
        for i in range(max(1, len(w) - size + 1)) if w else []:
            windows.setdefault(tuple(w[i:i + size]), set()).add(str(item))
    out = {}
    lengths = {len(w) for w in windows}
    for doc, text in docs:
        w, hit, who = words13(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    who |= found
        out[doc] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    want = brute_hits(zip(docs.doc_id, docs.text), zip(items.item_id, items.text))
    got = queries.QUERIES["op5_decontaminate"](spark, sf).toPandas()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.itertuples()} == want
    assert any(v[4] for v in want.values())


def test_bpe_equals_the_library(spark, documents):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    got = queries.QUERIES["op8_bpe"](spark, SF).toPandas().set_index("doc_id")
    for doc, e in zip(documents.doc_id, lib.encode_batch(documents.text.tolist(), add_special_tokens=False), strict=True):
        row = got.loc[doc]
        assert row.n_tokens == len(e.ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_against_brute_force(spark, documents):
    """Every stage but the first is repeated by plain loops; the first stage's decisions are taken from its operator."""
    scored = queries.QUERIES["op1_toxicity"](spark, SF).toPandas()
    docs = documents[documents.doc_id.isin(scored[scored.predicted == 0].doc_id)].copy()
    # line dedup by source
    bare = lambda s: s.strip(" \t\r")
    content = lambda t: tuple(dict.fromkeys(bare(x) for x in t.split("\n") if bare(x)))
    pages = {s: len({content(t) for t in g}) for s, g in docs.groupby("source").text}
    bearers = {}
    for i, t, s in sorted(zip(docs.doc_id, docs.text, docs.source)):
        for line in content(t):
            bearers.setdefault((s, line), {}).setdefault(content(t), i)
    drop = {k: next(iter(b)) for k, b in bearers.items() if len(b) >= 4 and len(b) > pages[k[0]] * 0.05}
    docs["text"] = ["\n".join(x for x in t.split("\n") if drop.get((s, bare(x)), content(t)) == content(t)) for t, s in zip(docs.text, docs.source)]
    comp = brute_components([brute_fingerprint(t) for t in docs.text], docs.doc_id.tolist())
    docs = docs[docs.doc_id == comp]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    hits = brute_hits(zip(docs.doc_id, docs.text), zip(items.item_id, items.text))
    docs = docs[[not hits[d][4] for d in docs.doc_id]]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.vocabulary())
    want = {d: hashlib.sha256(np.array(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for d, t in zip(docs.doc_id, docs.text)}
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert dict(zip(got.doc_id, got.ids_sha256)) == want
    assert len(got) == len(want)
