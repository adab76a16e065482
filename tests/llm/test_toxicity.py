import numpy as np

from featurestats.llm import toxicity


def test_noisy_or_against_brute_force():
    words = {"bad": 0, "awful": 1, "bad*": 2}
    model = toxicity.Model(words, np.array([2.0, 3.0, 0.5, 0.0, 0.0]), -4.0)
    texts = ["Bad day. Awful, AWFUL day!\nfine", "", "...", "baddest", "w " * 70 + "bad"]

    def brute(text):
        clean = 1.0
        for sentence in text.lower().replace("!", ".").replace("\n", ".").split("."):
            tokens = ["".join(c for c in w if c.isalpha()) for w in sentence.split()]
            for k in range(0, len(tokens), toxicity.SENTENCE):
                part = tokens[k:k + toxicity.SENTENCE]
                z = -4.0 + sum(2.0 * (t == "bad") + 3.0 * (t == "awful") + 0.5 * (t[:4] + "*" == "bad*") for t in part)
                clean *= 1 - 1 / (1 + np.exp(-z))
        return 1 - clean

    ids, starts, owner = toxicity.bags(texts, words)
    got = toxicity.noisy_or(toxicity.sentence_logits(ids, starts, model), owner, len(texts))
    assert np.allclose(got, [brute(t) for t in texts])
    assert toxicity.spans("It is. Awful awful thing! Yes", model, 0.5) == "7:25"


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.85
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) <= 0.02 * len(clean)
    assert all((r["predicted"] == 1) == (r["score"] >= 0.7) for r in rows)


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(k, 1, k % 2, "x") for k in range(40)] + [(None, 1, 1, "x"), (6, 1, None, "x"), (7, 1, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    docs = edge_docs.unionByName(spark.createDataFrame([(k, "vile words. here" if k % 2 else "kind words. here") for k in range(20, 40)], "doc_id bigint, text string"), allowMissingColumns=True)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3, 4))
    for some in (labels.where("toxic = 1"), labels.limit(0)):
        assert toxicity.train(docs, some) is None
    assert {r["score"] for r in toxicity.score(edge_docs, None).collect()} == {0.0}
    assert toxicity.train(no_docs, labels) is None and toxicity.score(no_docs, None).count() == 0


def test_long_rows_train_like_others(spark):
    """One label stands on long rows alone, and long clean documents are left alone; a smaller bound draws fewer rows."""
    import random

    draw = random.Random(1)
    words = [a + b for a in "ba lo mi tu re ka".split() for b in "den sta rin gol wes".split()]
    plain = lambda n: ". ".join(" ".join(draw.choice(words) for _ in range(8)) for _ in range(n))
    rows = [(k, plain(600 if k % 2 else 3) + (". you vile rotten scum" if k % 4 == 1 else "") + ". " + plain(2)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 1)) for k in range(240)], "doc_id bigint, toxic int")
    assert max(len(t) for _, t in rows) > 20_000
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    held = [k for k in got if got[k]["held_out"]]
    assert all(got[k]["predicted"] == int(k % 4 == 1) for k in held) and len(held) > 40
    few = toxicity.train(docs, labels, max_words=200)
    assert few is None or len(few.weights) > 2
