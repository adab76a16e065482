import re

import numpy as np
import pytest
import xxhash

from featurestats.llm import components, simhash


def brute_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(rows, bits=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def result(df):
    found = simhash.near_duplicates(df).select("doc_id", simhash.hex_fingerprint("fp"), "component_id")
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_components_against_brute_force(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(600)
    for df in (docs, edge_docs):
        assert result(df) == brute_components([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert result(no_docs) == []


def test_keep_one(spark, edge_docs, no_docs):
    rows = brute_components([tuple(r) for r in edge_docs.select("doc_id", "text").collect()])
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == sorted({c for _, _, c in rows if c is not None})
    assert got.count(None) == len({f for d, f, c in rows if c is None})
    # Rows that repeat an id but not the text are documents of their own.
    twins = spark.createDataFrame([(1, "a b c d e f"), (1, "u v w x y z"), (1, "a b c d e f"), (2, "u v w x y z")], "doc_id bigint, text string")
    assert sorted(r["text"] for r in simhash.keep_one(twins).collect()) == ["a b c d e f", "u v w x y z"]
    assert simhash.keep_one(no_docs).count() == 0


@pytest.mark.parametrize("bucket", [16, 8192])
def test_links_connect_all_near_pairs(spark, bucket):
    """With tiny buckets most are searched by pairs of chunks."""
    draw = np.random.default_rng(bucket)
    base = draw.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in draw.choice(64, draw.integers(1, 7), replace=False))) for b in base for _ in range(4)]
    dense = [np.uint64(0xF0F0) ^ np.uint64(k) for k in range(40)]  # a hot bucket
    fps = np.unique(np.concatenate([base, near, dense]).astype(np.uint64))
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    found = simhash.links(nodes, 4, bucket).collect()
    label = {int(f): int(f) for f in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in found:
        a, b = a & (1 << 64) - 1, b & (1 << 64) - 1
        label[find(a)] = find(b)
    apart = np.bitwise_count(fps[:, None] ^ fps[None])
    for i, j in zip(*np.nonzero(np.triu(apart <= 4, 1))):
        assert find(int(fps[i])) == find(int(fps[j]))
    # Nothing but near pairs is connected.
    want = {int(f): int(f) for f in fps}

    def root(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(apart <= 4, 1))):
        want[root(int(fps[i]))] = root(int(fps[j]))
    assert len({find(int(f)) for f in fps}) == len({root(int(f)) for f in fps})


def test_masks():
    draw = np.random.default_rng(3)
    for n, k in ((10, 1), (1 << 30, 2), (1 << 36, 3)):
        chosen = simhash.masks(n, 4)
        assert len(chosen) == {1: 5, 2: 15, 3: 35}[k]
        for _ in range(200):
            apart = sum(1 << int(b) for b in draw.choice(64, 4, replace=False))
            assert any(not apart & m for m in chosen)


def test_gray_rank():
    x = np.arange(256, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 200), (200, 150), (7, 7)], "a bigint, b bigint")
    got = {tuple(r) for r in components.components(links).collect()}
    assert got == {(i, 0) for i in range(51)} | {(100, 100), (200, 100), (150, 100)}
    assert components.components(links.limit(0)).count() == 0
