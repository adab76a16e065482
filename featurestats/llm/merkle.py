"""Operator 11: a Merkle manifest of a dataset, with a proof for each row, as a nested-struct rollup.

A row's leaf is the hash of its columns.  Leaves are ranked within their group (by id); the base-8 digits of the rank say
where a leaf hangs.  A block holds the nodes of ``8 ** BLOCK_LEVELS`` consecutive ranks: its rows are grouped on the digits,
lowest first, and each grouping nests the child structs under one digit less, until a block is one row (bounded) with its own
hash.  The blocks' hashes are the nodes of the next tier, and so on until each group has one; the groups' hashes, ranked by
group, make the last tiers in the same way.  Proofs come from the top: each nested level is transformed into (child,
siblings before, siblings after) and exploded, which lengthens the path.  A lower tier's blocks meet the paths of their
roots in one aggregation over both, so nothing is joined on the way down.

Ranks need no window over a group: rows are written in order (range-partitioned, so that a large group lies in many
files), and a file's rows are counted from the number of rows of the files before it.

Results: one row for each row.  A null column is hashed as such; a null group is a group (the first); null ids stand first
in theirs.  Equal ids stand in the order of their leaves; repeated rows are leaves of their own.  An empty table has no
rows and no root.  Long texts are hashed whole.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialize, shared_folder

ARITY_BITS = 3
#: Levels of the tree within a block: 512 nodes, about 100 kB.
BLOCK_LEVELS = 3
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_of(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(c) for c in columns)), 256)


def ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, by ``order``) within ``grp`` and ``size``, the number of the group's rows."""
    spark = nodes.sparkSession
    path = shared_folder(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by where they stand, so that any number of them spreads over partitions.
    keyed = nodes.withColumn("_at", F.monotonically_increasing_id())
    by = ["grp", *order, "_at"]
    keyed.repartitionByRange(n, *by).sortWithinPartitions(*by).write.parquet(path)
    rows = spark.read.schema(keyed.schema).parquet(path).select(
        *nodes.columns, "_at", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # One row for each file and group in it.
    runs = rows.groupBy("_file", "grp").agg(F.min(F.struct(*order, "_at")).alias("_low"), F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("grp").orderBy("_low").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_file", "grp", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_first",
                       F.sum("_n").over(Window.partitionBy("grp")).alias("size"))
    return rows.join(runs, ["_file", "grp"]).select(*nodes.columns, (F.col("_before") + F.col("_row") - F.col("_first")).alias("rank"), "size")


def blocks_of(nodes: DataFrame, payload: list[str], name: str) -> DataFrame:
    """One row for each block of ``nodes`` (grp, rank, size, hash, payload): its hash and nested ``kids``.

    A level is hashed only while the group has more than one node on it."""
    digits = [f"_d{k}" for k in range(BLOCK_LEVELS)]
    at = F.col("rank")
    rolled = nodes.select(
        "grp", "size", F.shiftright(at, ARITY_BITS * BLOCK_LEVELS).alias("block"),
        *(F.shiftright(at, ARITY_BITS * k).bitwiseAND((1 << ARITY_BITS) - 1).cast("tinyint").alias(d) for k, d in enumerate(digits)),
        "hash", *payload).repartition("grp", "block")
    held = ["hash", *payload]
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(digit, *held)))
        rolled = rolled.groupBy("grp", "size", "block", *digits[k + 1:]).agg(kids.alias("kids"))
        joined = F.sha2(F.array_join(F.col("kids.hash"), ""), 256)
        rolled = rolled.withColumn("hash", F.when(F.col("size") > 1 << ARITY_BITS * k, joined).otherwise(F.col("kids")[0]["hash"]))
        held = ["hash", "kids"]
    return materialize(rolled.select("grp", "size", "block", "hash", "kids"), name)


def tiers_of(nodes: DataFrame, payload: list[str], name: str) -> list[DataFrame]:
    """The blocks of each tier, from the leaves up, until each group has one."""
    tiers = [blocks_of(nodes, payload, f"{name}-0")]
    while not tiers[-1].where("block > 0").isEmpty():
        above = tiers[-1].select("grp", F.col("block").alias("rank"), F.ceil(F.col("size") / (1 << ARITY_BITS * BLOCK_LEVELS)).alias("size"), "hash")
        tiers.append(blocks_of(above, [], f"{name}-{len(tiers)}"))
    return tiers


def unrolled(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of ``blocks`` (with a ``path`` above them, and ``carried`` columns), each with its path: grp, rank, node, path."""
    out = blocks.select("grp", "size", "path", *carried, F.col("block").alias("rank"), F.struct("hash", "kids").alias("node"))
    for k in reversed(range(BLOCK_LEVELS)):
        # The kids' hashes before and after each kid.
        split = ("inline(transform(node.kids, (k, i) -> named_struct('kid', k, 'up', named_struct("
                 "'before', array_join(slice(node.kids.hash, 1, i), ''), 'after', array_join(slice(node.kids.hash, i + 2, 8), '')))))")
        out = out.selectExpr("grp", "size", "path", *carried, "rank", split)
        longer = F.when(F.col("size") > 1 << ARITY_BITS * k, F.concat(F.array("up"), F.col("path"))).otherwise(F.col("path"))
        out = out.select("grp", "size", longer.alias("path"), *carried, F.expr(f"(rank << {ARITY_BITS}) + kid._d{k}").alias("rank"), F.col("kid").alias("node"))
    return out


PATH = "array<struct<before:string,after:string>>"


def paths_down(tiers: list[DataFrame], tops: DataFrame, carried: list[str]) -> DataFrame:
    """The nodes of the lowest tier with their paths; ``tops``: grp, path and ``carried`` of each group's top."""
    above = tops.select("grp", F.lit(0).cast("bigint").alias("block"), "path", *carried)
    for k, blocks in reversed([*enumerate(tiers)]):
        lower = blocks.select("grp", "block", "size", "hash", "kids")
        both = lower.unionByName(above, allowMissingColumns=True)
        met = both.groupBy("grp", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("size", "hash", "kids", "path", *carried)))
        nodes = unrolled(met, carried)
        above = nodes.select("grp", F.col("rank").alias("block"), "path", *carried) if k else nodes
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, up: F.sha2(F.concat(up["before"], h, up["after"]), 256))


def proof_of(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda up: F.concat(up["before"], up["after"])), ""), 256)


def manifest(leaves: DataFrame, payload: list[str]) -> DataFrame:
    """Per leaf: ``payload``, leaf, subroot (of its group), root and the path of siblings from the leaf up.

    ``leaves``: grp (string, not null), hash, doc_id and the payload columns; leaves ascend by doc_id in their group."""
    spark = leaves.sparkSession
    tiers = tiers_of(ranked(leaves, ["doc_id", "hash"], "merkle-ranked"), payload, "merkle-leaves")
    subroots = tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of_group"), "hash")
    top_tiers = tiers_of(ranked(subroots, ["of_group"], "merkle-groups"), ["of_group"], "merkle-top")
    no_path = F.array().cast(PATH)
    tops = top_tiers[-1].select("grp", no_path.alias("path"), F.col("hash").alias("root"))
    groups = paths_down(top_tiers, tops, ["root"]).select(
        F.col("node.of_group").alias("grp"), "path", "root", F.col("node.hash").alias("subroot"))
    return paths_down(tiers, groups, ["root", "subroot"]).select(
        *(F.col(f"node.{c}").alias(c) for c in payload), F.col("node.hash").alias("leaf"), "subroot", "root", "path")


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents, and of those whose id's CRC-32 3 divides the leaf of the lower-cased text."""
    typed = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "source", "lang", "CAST(n_chars AS BIGINT) n_chars", "text")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    small = F.translate("text", CAPITALS, SMALL)
    return typed.select(
        F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("grp"), "doc_id", hash_of([*columns, F.col("text")]).alias("hash"),
        F.when(fold("doc_id", 3) == 0, hash_of([*columns, small])).alias("tampered"))


def verify_documents(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs``, folded again from leaves of which a third was tampered with."""
    leaves = materialize(document_leaves(docs), "merkle-hashes")  # the texts are read once
    proofs = manifest(leaves, ["doc_id", "tampered"])
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (proofs.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _sql(levels: int = 8, group_levels: int = 4) -> str:
    """The same in SQL: one CTE for each level, up to 8 ** levels documents of a language and 8 ** group_levels languages."""

    def tree(name: str, depth: int) -> list[str]:
        """Levels name0 (given) to name<depth>, and the siblings of each node on them."""
        out = []
        for k in range(depth):
            out.append(f"""{name}s{k} AS (SELECT grp, i, n,
  coalesce(string_agg(h, '') OVER (PARTITION BY grp, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(h, '') OVER (PARTITION BY grp, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
            out.append(f"""{name}{k + 1} AS (SELECT grp, i // 8 AS i, (n + 7) // 8 AS n,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY grp, i // 8, n)""")
        return out

    part = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    head = " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    small = f"translate(text, '{CAPITALS}', '{SMALL}')"
    ctes = [
        # CRC-32 of the decimal id: bit by bit over its digits.
        """crc AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS state
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))""",
        f"""leaves AS (SELECT d.doc_id, coalesce('+' || lang, '') AS grp, sha256({head.replace('doc_id', 'd.doc_id')} || {part.format('text')}) AS h,
  CASE WHEN xor(state, 4294967295::BIGINT) % 3 = 0 THEN sha256({head.replace('doc_id', 'd.doc_id')} || {part.format(small)}) END AS tampered
  FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaves)""",
        "a0 AS (SELECT grp, i, n, h FROM placed)", *tree("a", levels),
        f"b0 AS (SELECT '' AS grp, grp AS of_group, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})",
        *tree("b", group_levels)]
    joins = [f"JOIN as{k} s{k} ON s{k}.grp = p.grp AND s{k}.i = p.i // {8 ** k}" for k in range(levels)]
    joins += [f"JOIN b0 ON b0.of_group = p.grp CROSS JOIN (SELECT h AS root FROM b{group_levels}) r"]
    joins += [f"JOIN bs{k} t{k} ON t{k}.i = b0.i // {8 ** k}" for k in range(group_levels)]
    ups = [f"s{k}" for k in range(levels)] + [f"t{k}" for k in range(group_levels)]
    proof = " || ".join(f"CASE WHEN {u}.n > 1 THEN {u}.before || {u}.after ELSE '' END" for u in ups)
    ctes.append("""x0 AS (SELECT p.doc_id, p.h AS leaf, b0.h AS subroot, root, sha256(%s) AS proof_sha256, coalesce(tampered, p.h) AS f, %s FROM placed p %s)""" % (
        proof, ", ".join(f"{u}.n AS {u}n, {u}.before AS {u}b, {u}.after AS {u}a" for u in ups), " ".join(joins)))
    for k, u in enumerate(ups):
        ctes.append(f"x{k + 1} AS (SELECT * REPLACE (CASE WHEN {u}n > 1 THEN sha256({u}b || f || {u}a) ELSE f END AS f) FROM x{k})")
    return ("WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM x{len(ups)}""")


SQL = _sql()
