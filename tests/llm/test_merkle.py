import hashlib
import zlib

from pyspark.sql import functions as F

from featurestats.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def reduce_up(nodes):
    """(root, [siblings before and after of each level] of each node) of plain lists."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k:k + 8] for k in range(0, len(level), 8)]
        for i, a in enumerate(at):
            run, k = runs[a // 8], a % 8
            paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            at[i] = a // 8
        level = [sha(*r) for r in runs]
    return level[0], paths


def brute(rows):
    leaves = []
    for doc_id, text, lang, source, n in rows:
        leaf = sha(*map(field, (doc_id, source, lang, n, text)))
        small = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        leaves.append((lang, doc_id, leaf, sha(*map(field, (doc_id, source, lang, n, small))) if tampered else leaf))
    langs = sorted({x[0] for x in leaves}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((x for x in leaves if x[0] == lang), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        trees.append((own, *reduce_up([x[2] for x in own])))
    root, tops = reduce_up([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for (_, doc_id, leaf, folded), path in zip(own, paths):
            h = folded
            for before, after in path + top:
                h = sha(before, h, after)
            out.append((doc_id, leaf, subroot, root, sha(*(a + b for a, b in path + top)), h, h == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def check(df):
    got = sorted((tuple(r) for r in merkle.verify_documents(df).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select(*COLUMNS).collect()])


def test_documents(docs, edge_docs, no_docs):
    check(docs)
    check(edge_docs)  # null ids, texts, languages; ties; repeated rows; clashing columns
    assert merkle.verify_documents(no_docs).count() == 0


def test_runs_levels_and_single_nodes(spark):
    """Groups of 1, 7, 8, 9, 64, 65, 513 and 4097 rows: partial runs, lone nodes at the end of a level, several tiers; many
    languages, the null one and an empty one first."""
    sizes = {None: 1, "": 7, "a": 8, "ä": 9, "b": 64, "c": 65, "d": 513, "z": 4097, **{f"l{k}": 1 for k in range(60)}}
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append(((n * 7919) % 100_003, f"Text {n}", lang, None if n % 5 else "s", n))
    check(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))


def test_one_row_and_many_equal_rows(spark):
    one = [(3, "A", "en", "s", 1)]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    check(spark.createDataFrame(one, ddl))
    got = merkle.verify_documents(spark.createDataFrame(one, ddl)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("")
    check(spark.createDataFrame(one * 700 + [(None, None, None, None, None)] * 3, ddl))


def test_ranks_need_no_partition_of_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "shared_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(5000).select((F.col("id") * 37 % 5003).alias("doc_id"), F.lit("g").alias("grp"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    got = merkle.ranked(rows, ["doc_id", "hash"], "t-ranked")
    assert [r["rank"] for r in got.orderBy("doc_id").collect()] == list(range(5000)) and {r["size"] for r in got.collect()} == {5000}
    assert len([*tmp_path.glob("t-ranked/*.parquet")]) == 4  # the group lies in as many files as there are partitions


def test_proofs_go_down_without_joins(docs):
    leaves = merkle.document_leaves(docs)
    tiers = merkle.tiers_of(merkle.ranked(leaves, ["doc_id", "hash"], "t-leaves"), ["doc_id", "tampered"], "t-tiers")
    tops = tiers[-1].select("grp", F.array().cast(merkle.PATH).alias("path"), F.col("hash").alias("root"))
    plan = merkle.paths_down(tiers, tops, ["root"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
