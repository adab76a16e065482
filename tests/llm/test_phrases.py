import hashlib

import numpy as np

from featurestats.llm import phrases


def brute_order(df):
    return sorted(((r[0], r[1] or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def check(df):
    rows = brute_order(df)
    got = sorted(phrases.fingerprint_documents(df).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    want = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        own, other, after = phrases.sketches([text])[0], phrases.sketches([edited])[0], phrases.sketches([following])[0]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.as_hex(own), phrases.as_hex(other), phrases.likeness(own, other), phrases.likeness(own, after)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_documents(spark, docs, edge_docs, no_docs):
    check(docs)
    check(edge_docs)
    check(docs.limit(1))
    check(edge_docs.where("doc_id IS NULL"))
    assert phrases.fingerprint_documents(no_docs).count() == 0


def test_blocks_by_hand():
    """Coin tossing on one small string, from the definition."""
    text = "the quick brown fox jumps over the lazy dog"
    label = [ord(c) for c in text]
    for _ in range(4):
        new = [label[0] & 1]
        for a, b in zip(label, label[1:]):
            k = ((a ^ b) & -(a ^ b)).bit_length() - 1
            new.append(2 * k + (b >> k & 1))
        label = new
    assert max(label) < 6 and all(a != b for a, b in zip(label, label[1:]))
    starts = [0] + [i for i in range(1, len(label) - 1) if label[i - 1] < label[i] > label[i + 1]]
    first = np.zeros(len(text), bool)
    first[0] = True
    assert phrases.block_starts(np.array([ord(c) for c in text], np.uint32), first).tolist() == starts


def test_equal_substrings_share_their_names(docs):
    text = max((r["text"] for r in docs.select("text").collect()), key=len)
    part = text[1000:3000]
    inside = set(phrases.sketches([part], 10**9)[0].tolist())
    for shift in (0, 1, 7):
        around = set(phrases.sketches(["#" * shift + "zq" + part + "end of it"], 10**9)[0].tolist())
        assert len(inside & around) > 0.9 * len(inside)
    # A text's names don't depend on what it is parsed with.
    assert [s.tolist() for s in phrases.sketches([part, "aaaa", "", part])] == [phrases.sketches([t])[0].tolist() for t in (part, "aaaa", "", part)]
