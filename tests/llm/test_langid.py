from featurestats.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, langid.learn_profiles(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.95


def test_distance_against_brute_force(docs):
    """Ranks by hand, from dictionaries."""
    from collections import Counter

    def grams(text):
        out, word = Counter(), ""
        text = "".join(c if c.isalpha() else " " for c in text.lower())
        for word in text.split():
            w = f" {word} "
            out.update(w[i:i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1))
        words = text.split()
        del out[" "]
        return out, words

    def number(g):
        return sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))

    def ranked(text):
        return [number(g) for g, n in sorted(grams(text)[0].items(), key=lambda x: (-x[1], number(x[0])))][:300]

    some = docs.limit(40).select("text", "lang").collect()
    by_lang = {}
    for r in some:
        by_lang.setdefault(r["lang"], []).append(r["text"])
    profiles = {lang: ranked(" ".join(ts)) for lang, ts in by_lang.items()}
    classify = langid.Classifier(profiles)
    for r in some:
        own = ranked(r["text"])
        apart = {}
        for lang, profile in profiles.items():
            place = {g: k for k, g in enumerate(profile)}
            apart[lang] = sum(abs(place[g] - k) if g in place else 300 for k, g in enumerate(own))
        best = min(sorted(apart), key=apart.get)
        got = classify(r["text"])
        assert got[0] == best and abs(got[1] - (1 - apart[best] / (300 * len(own)))) < 1e-9


def test_edges(edge_docs, no_docs):
    profiles = langid.learn_profiles(edge_docs)
    rows = langid.identify(edge_docs, profiles).collect()
    assert len(rows) == edge_docs.count()
    assert {(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] in (1, 2, 3, 4, 12)} == {("und", 0.0)}
    assert all(r["held_out"] is False for r in rows if r["doc_id"] is None)
    kept = langid.reject_unidentified(edge_docs, profiles, 0.0)
    assert kept.columns == edge_docs.columns and kept.count() == len(rows) - sum(r["lang_pred"] == "und" for r in rows)
    assert langid.learn_profiles(no_docs) == {} and langid.identify(no_docs, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(edge_docs, {}).collect()} == {"und"}
