import random

from featurestats.llm import tiling


def brute(doc, item, least=tiling.MIN_MATCH):
    """Plain greedy string tiling: the longest match of unmarked words first, leftmost on ties."""
    free_doc, free_item, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and free_doc[a + n] and free_item[b + n] and doc[a + n] == item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return out
        out.append(best[0])
        for k in range(best[0]):
            free_doc[best[1] + k] = free_item[best[2] + k] = False


def test_tiles_against_brute_force():
    draw, in_word = random.Random(5), tiling.word_table()
    for _ in range(120):
        kinds = draw.choice([2, 3, 6])
        doc, item = ([str(draw.randrange(kinds)) for _ in range(draw.randint(lo, hi))] for lo, hi in ((0, 22), (4, 16)))
        if draw.random() < 0.6 and len(item) > 8:
            k = draw.randint(4, len(item) - 4)
            doc = doc[:9] + item[k:] + doc[9:] + item[:k]
        want = brute(doc, item)
        got = list(tiling.leaks_of([" ".join(doc), "x"], tiling.Items([(7, " ".join(item))]), in_word, 1e-6))
        assert [(g[1], g[3], g[4], g[5]) for g in got] == ([(7, len(want), sum(want), want[0])] if want else [])


def test_leaks(spark, edge_docs, no_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    benchmark = spark.createDataFrame(
        [(1, item, "x"), (1, item, "x"), (2, "one two three four five", "x"), (3, None, "x"), (4, "", "x"), (5, "one two", "x"), (None, "nu xi omicron pi rho sigma", "x")],
        "item_id bigint, text string, doc_id string")
    texts = {20: f"Before, {item.upper()}! after", 21: " ".join(words[6:] + ["between"] + words[:6]), 22: " ".join(words[:4]) + " and more", 23: " ".join(words[::-1]),
             24: "nu xi omicron, pi rho sigma tau", 25: None}
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in tiling.find_leaks(docs, benchmark).collect()}
    assert got == {(20, 1, 1), (21, 1, 2), (24, None, 1)}
    assert sorted(r["doc_id"] for r in tiling.find_leaks(edge_docs, benchmark).collect()) == [6, 6, 7]
    kept = tiling.without_leaks(edge_docs, benchmark)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 3
    assert tiling.find_leaks(no_docs, benchmark).count() == 0 and tiling.without_leaks(no_docs, benchmark).count() == 0
    assert tiling.find_leaks(docs, benchmark.limit(0)).count() == 0 and tiling.without_leaks(docs, benchmark.limit(0)).count() == 6


def test_blocks_find_the_same(spark, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, tiling.find_leaks(docs, benchmark).collect()))
    many = tiling.blocks_of(benchmark, 2000)
    assert len(many) > 2
    monkeypatch.setattr(tiling, "blocks_of", lambda b: many)
    assert sorted(map(tuple, tiling.find_leaks(docs, benchmark).collect())) == whole and whole
    assert tiling.without_leaks(docs, benchmark).count() == docs.count() - len({r[0] for r in whole})


def test_repeated_words_cost_no_more_than_document_times_item():
    """A document of one word held against items of that word, and against items that break off it in the middle."""
    import time

    in_word, text = tiling.word_table(), "la " * 100_000
    whole = [(k, "la " * (60 + k % 40)) for k in range(200)]
    broken = [(1000 + k, "la " * 50 + f"x{k} " + "la " * 49) for k in range(20)]
    start = time.process_time()
    got = {g[1]: g[3:] for g in tiling.leaks_of([text], tiling.Items(whole), in_word, 0.5)}
    assert got == {k: (1, 60 + k % 40, 60 + k % 40) for k in range(200)}
    got = {g[1]: g[3:] for g in tiling.leaks_of([text], tiling.Items(broken), in_word, 0.5)}
    assert got == {1000 + k: (2, 99, 50) for k in range(20)}
    assert time.process_time() - start < 30
    small = " ".join(["la"] * 120)
    for item in (broken[0][1], "la la la si la la la la la si si la la la la la la"):
        want = brute(small.split(), item.split())
        assert [(g[3], g[4], g[5]) for g in tiling.leaks_of([small], tiling.Items([(1, item)]), in_word, 1e-6)] == [(len(want), sum(want), want[0])]


def test_all_diagonals_give_the_tiles_of_window_pairs(monkeypatch):
    draw, in_word = random.Random(8), tiling.word_table()
    cases = []
    for _ in range(60):
        doc, item = ([str(draw.randrange(2)) for _ in range(n)] for n in (draw.randint(10, 60), draw.randint(5, 20)))
        cases.append((" ".join(doc), " ".join(item), brute(doc, item)))
    for pairs, cells in ((0, 7), (1 << 20, 1 << 22)):
        monkeypatch.setattr(tiling, "PAIRS", pairs)
        monkeypatch.setattr(tiling, "CELLS", cells)
        for doc, item, want in cases:
            got = list(tiling.leaks_of([doc], tiling.Items([(1, item)]), in_word, 1e-6))
            assert [(g[3], g[4], g[5]) for g in got] == ([(len(want), sum(want), want[0])] if want else [])


def test_shared_opening_pairs_no_document_with_every_item():
    """20,000 items open alike; documents with that opening are paired with those whose own words they hold, and none is lost."""
    in_word, opening = tiling.word_table(), "which of the following statements about the given passage is true"
    items = [(k, f"{opening} " + " ".join(f"w{k}x{j}" for j in range(14))) for k in range(20_000)]
    items += [(50_000, opening), (50_001, opening + " yes")]  # these consist of it
    block = tiling.Items(items)
    text = "filler " * 3000 + opening + " and so on " + items[77][1] + " " + items[4321][1].split(" ", 11)[-1]
    words, first = tiling.word_hashes([text], in_word)
    seed = tiling.np.unique(block.hits(words, first)[2])
    assert {block.ids[i] for i in block.pairs(seed)} == {77, 4321, 50_000, 50_001}
    got = {g[1] for g in tiling.leaks_of([text, opening, "nothing"], block, in_word, 0.5) if g[0] == 0}
    assert got == {77, 4321, 50_000, 50_001}
    assert [g[1] for g in tiling.leaks_of([opening], block, in_word, 0.5)] == [50_000, 50_001]


def test_triggers_lose_no_leak():
    """Few words, so that most seeds are hot: the leaks are those of a join on all seeds."""
    draw, in_word = random.Random(11), tiling.word_table()
    items = [(k, " ".join(str(draw.randrange(3)) for _ in range(draw.randint(4, 24)))) for k in range(150)]
    texts = [" ".join(str(draw.randrange(3)) for _ in range(draw.randint(0, 40))) for _ in range(40)]
    block, every = tiling.Items(items), tiling.Items(items)
    own, owner = tiling.np.concatenate(every.seeds), tiling.np.repeat(tiling.np.arange(len(every.ids)), [len(s) for s in every.seeds])
    order = tiling.np.argsort(own, kind="stable")
    every.seed, every.owner = own[order], owner[order]
    assert len(block.seed) < len(tiling.np.unique(tiling.np.stack([own, owner.astype(own.dtype)]), axis=1).T)
    assert list(tiling.leaks_of(texts, block, in_word, 0.5)) == list(tiling.leaks_of(texts, every, in_word, 0.5))
