import math
import re
from collections import Counter

import pytest

from featurestats.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string, doc_id string, rank string, score string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    docs = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t in docs) if t]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items}:
        scored = []
        for doc_id, c in docs:
            m = 75 + (25 * sum(c.values()) * n_docs) // total
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, k in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def got(docs, items, **kw):
    return sorted((tuple(r) for r in lexical.search(docs, items, **kw).collect()), key=repr)


def plain(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def test_documents(docs, benchmark):
    assert got(docs, benchmark) == brute(plain(docs, "doc_id", "text"), plain(benchmark, "item_id", "text"))


def test_small_shards_stages_and_blocks_give_the_same(docs, benchmark, monkeypatch):
    """Bounds drop documents between stages and shards, items come in many blocks: the choice stays exact."""
    want = brute(plain(docs, "doc_id", "text"), plain(benchmark, "item_id", "text"), 3)
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 3)
    for bits, owners in ((4, (1 / 8, 1.0)), (5, (0.2, 0.4, 0.6, 0.8, 1.0)), (12, (1.0,))):
        monkeypatch.setattr(lexical, "SHARD_BITS", bits)
        monkeypatch.setattr(lexical, "OWNERS", owners)
        assert got(docs, benchmark, top=3) == want
    monkeypatch.setattr(lexical, "OWNERS", (0.5, 1.0))
    assert len(list(lexical.blocks_of(benchmark, 300))) > 5
    assert got(docs, benchmark, top=3, block_terms=300) == want


def test_bundles_shrink_by_the_bounds(docs, benchmark, monkeypatch):
    """With shards of 64 documents and the 3 best wanted, fewer pairs travel than have a posting."""
    monkeypatch.setattr(lexical, "SHARD_BITS", 6)
    block = next(lexical.blocks_of(benchmark))
    index = lexical.counted(docs, block)
    n_docs, total = index.agg({"*": "count", "n": "sum"}).first()
    w, df, most = lexical.weights(index, n_docs, len(block.number))
    owner = lexical.owners_of(df)
    packed = lexical.postings(index, n_docs, total, w, owner)
    empty = lexical.pa.table({"shard": lexical.pa.array([], "int64"), "item": lexical.pa.array([], lexical.pa.list_(lexical.pa.int32())),
                              "at": lexical.pa.array([], lexical.pa.list_(lexical.pa.int32())), "score": lexical.pa.array([], lexical.pa.list_(lexical.pa.int64()))})
    last = len(lexical.OWNERS) - 1
    found = packed.where(f"owner = {last}").toArrow()
    kept = 0
    for s in set(found["shard"].to_pylist()):
        mine = found.filter(lexical.pc.equal(found["shard"], s))
        free = lexical.stage(block, owner, most, last, 1 << 6)(empty, mine)
        kept += len(lexical.stage(block, owner, most, last, 3)(empty, mine)) < len(free)
    assert kept


def test_edges(spark, edge_docs, no_docs):
    items = [(1, "one two THREE three", "x", "x", "x"), (1, "one two THREE three", "x", "x", "x"), (1, "lorem", "x", "x", "x"), (2, None, "x", "x", "x"),
             (3, "", "x", "x", "x"), (4, "... !!", "x", "x", "x"), (None, "null id words", "x", "x", "x"), (5, "日本語 🙂 ünïcode k", "x", "x", "x"), (6, "nowhere", "x", "x", "x"),
             (7, "x" * 50_000, "x", "x", "x"), (8, "1 2 3 password abcdef123", "x", "x", "x")]
    benchmark = spark.createDataFrame(items, ITEMS)
    docs = plain(edge_docs, "doc_id", "text")
    assert got(edge_docs, benchmark) == brute(docs, [x[:2] for x in items])
    assert got(no_docs, benchmark) == [] and got(edge_docs, benchmark.limit(0)) == [] and got(edge_docs, benchmark.where("item_id = 2")) == []
    same = edge_docs.where("doc_id = 6").unionByName(edge_docs.where("doc_id = 6"))  # ties of one id
    assert got(same, benchmark) == brute(plain(same, "doc_id", "text"), [x[:2] for x in items])


def test_terms_of():
    for text in ("Aé-b_9\x00Z~ü", "ÀB", "", "\x7f\x80", "İ K ſ", "a b"):
        assert [t.decode("utf-8", "surrogatepass") for t in lexical.terms_of(text)] == terms(text)
    assert lexical.terms_of(None) == []
