import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from featurestats.llm.common import materialize
from featurestats.llm import langid, secrets, simhash, tiling


def brute(spark, docs, benchmark):
    """The stages again, row by row on the driver."""
    rows = [r.asDict() for r in docs.collect()]
    classify = langid.Classifier(langid.learn_profiles(docs))
    rows = [r for r in rows if (c := classify(r["text"]))[0] != "und" and c[1] >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    rows.sort(key=lambda r: r["doc_id"])
    fps, root = [simhash.fingerprint(r["text"]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    rows = [r for k, r in enumerate(rows) if root[k] == k]
    items, in_word = tiling.Items([(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()]), tiling.word_table()
    bad = {x[0] for x in tiling.leaks_of([r["text"] for r in rows], items, in_word, tiling.COVERAGE)}
    rows = [r for k, r in enumerate(rows) if k not in bad]
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for r in rows:
        spans = [(b["start"], b["end"], b["kind"]) for b in secrets.findings(r["text"])[0]]
        text = secrets.replace_spans(r["text"], sorted(spans), "[{}]")
        out.append((r["doc_id"], len(text) if spans else r["n_chars"], library.encode(text, add_special_tokens=False).ids))
    return out


def test_run_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["ids"]) for r in rows) == sorted(brute(spark, docs, benchmark))
    assert all(r["round_trip"] for r in rows)


def test_stages_keep_the_columns(spark, edge_docs, no_docs):
    sf = "/root/testdata/sf0.001"
    for df in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, sf).columns == df.columns, name


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert {f"op{n}" for n in (5, 11, 12, 13)} == {n.split("_")[0] for n in entry.oracle_sql() if n.startswith("op")} and "pipeline" not in entry.oracle_sql()


def _through(spark, docs, sf_dir="/root/testdata/sf0.001"):
    """The rows after each stage, every plan run to its end."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"t-{name}")
        out.append((name, docs.collect()))
    return out


def test_edges_through_all_stages(spark, edge_docs, no_docs):
    """Nulls, empty and long texts, ties and repeated rows go through every stage, with defined results."""
    stages = dict(_through(spark, edge_docs))
    kept = {r["doc_id"] for r in stages["language"]}
    assert not kept & {1, 2, 3, 4, 12}  # no letter: no language
    assert {6, 8, 13} <= kept
    six = [r for r in stages["near_duplicates"] if r["doc_id"] in (6, 7)]
    assert {r["doc_id"] for r in six} == {6}  # of equal texts the smallest id stays
    last = stages["encode"]
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in last)
    assert len(last) == len(stages["secrets"]) and 13 in {r["doc_id"] for r in last}
    texts = {r["doc_id"]: r["text"] for r in stages["secrets"]}
    assert texts[13] == "[assign] mail me a@b.co"
    assert [len(rows) for _, rows in _through(spark, no_docs)] == [0] * len(corpus_pipeline.STAGES)


def test_an_added_span_is_redacted_in_the_pipeline(spark):
    """A vendor key, which no base pattern matches, and a clean document that must stay."""
    key = "sk_live_" + "aZ3kQ9xT7bLm2VcR8nYp4WsD"
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    more = [(900_001, f"thaner stioner andhe the ertion hathe onstion {key} and edre inghan of the report", "en", "s", 1), (900_002, "the thaner stioner andhe ertion hathe onstion edre of it", "en", "s", 1)]
    both = docs.unionByName(spark.createDataFrame(more, docs.schema))
    stages = dict(_through(spark, both, "/root/testdata/sf0.01"))
    texts = {r["doc_id"]: r["text"] for r in stages["secrets"]}
    assert key not in texts[900_001] and "[assign]" in texts[900_001] and texts[900_002] == more[1][1]
    assert {900_001, 900_002} <= {r["doc_id"] for r in stages["encode"]}
