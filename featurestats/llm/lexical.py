"""Operator 12: exact ranked search by pipelined term partitioning.

Items are taken in blocks of a bounded vocabulary.  One scan counts, for each document, all its terms and those of the
block (``counted``).  The block's terms are dealt to ``OWNERS`` owners, the rarest to the first and the common ones to the
last, and each owner's postings, with their integer contributions, are packed by shards of ``SHARD`` documents.  The bundle of
a block's items then passes through the owners' stages: in each, a shard's bundle (item, document, score so far) and the
owner's postings of that shard meet in a cogroup, and the contributions are added.  The last stage keeps each item's best
documents of a shard; a window over those makes the final choice.

What travels is sparse, and shrinks by exact bounds: after a stage, a document is dropped for an item only if 20 others of
its shard already have more than it could reach with all contributions still to come.  Should it turn up again in a later stage,
its (then too small) score cannot pass those 20 either.

Results: a null text has no terms, and neither has a text without letters, digits or non-ASCII characters; such documents
count nowhere.  Repeated rows and equal doc_ids are documents of their own; a null doc_id stands after others of its score.
Equal (item_id, text) rows are one item, other rows with the same item_id items of their own.  Items without terms, or whose
terms no document holds, have no rows.  Long texts are read whole.  Empty tables give no rows.  Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scan, schema_of

TOP = 20
#: Distinct terms of a block of items at about most: what a task holds of the query side.
BLOCK_TERMS = 200_000
#: Share of the postings up to which the owners of the rarer terms reach; the last has the rest.
OWNERS = (1 / 64, 1 / 16, 1 / 4, 1.0)
#: Documents of a shard.
SHARD_BITS = 12
#: Items of a block whose scores are added in one dense table.
ITEMS_AT_ONCE = 256
COUNTED = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
POSTINGS = "owner int, shard bigint, kind int, term array<int>, at array<int>, value array<bigint>"
BUNDLE = "shard bigint, item array<int>, at array<int>, score array<bigint>"
FOUND = "item int, doc_id bigint, score bigint"
OUT = "item_id bigint, rank int, doc_id bigint, score bigint"

#: ASCII letters to lower case, digits and bytes of other characters as they are, the rest to blanks.
TERM_BYTES = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


class Block:
    """Items of a block: their ids, terms and how often each item has each."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.ids = [i for i, _ in rows]
        self.number: dict[bytes, int] = {}
        triples = [(self.number.setdefault(t, len(self.number)), k, n)
                   for k, (_, text) in enumerate(rows) for t, n in Counter(terms_of(text)).items()]
        term, item, times = (np.array([x[c] for x in triples], np.int64) for c in range(3))
        order = np.lexsort((item, term))
        self.item, self.times = item[order], times[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.number) + 1))


def blocks_of(items: DataFrame, block_terms: int = BLOCK_TERMS):
    """The items in blocks, one at a time: Spark deals them by hash, so that a block has about ``block_terms`` terms."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    # A term and what parts it from the next are two bytes at least.
    size = rows.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0
    n = -(-int(size) // block_terms)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for k in range(n):
        held = Block([(r["item_id"], r["text"]) for r in rows.where(block == k).collect()])
        if held.number:
            yield held


def counted(docs: DataFrame, block: Block) -> DataFrame:
    """Per document that has a term: how many, and the block's terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(block.number)

    def make():
        number = shared.value.get

        def step(batch: pa.RecordBatch):
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = terms_of(text)
                if words:
                    own = Counter(map(number, words))
                    own.pop(None, None)
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append(list(own))
                    counts.append(list(own.values()))
            return [ids, sizes, terms, counts]

        return step

    return materialize(scan(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), make, COUNTED), "lexical-counts")


def weights(index: DataFrame, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per term of the block: weight, document frequency and the largest contribution that any document can give."""
    stats = (index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term"))
             .agg(F.count(F.lit(1)).alias("df"), F.max("t.counts").alias("most")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("weight")
    w, df, most = (np.zeros(n_terms, np.int64) for _ in range(3))
    rows = stats.select("term", weight, "df", "most").toArrow()  # at most the terms of a block
    at = rows.column("term").to_numpy()
    for to, name in ((w, "weight"), (df, "df"), (most, "most")):
        to[at] = rows.column(name).to_numpy()
    # No m is below 75.
    return w, df, w * ((1_000_000_000 * most) // np.maximum(1000 * most + 12 * 75, 1))


def owners_of(df: np.ndarray) -> np.ndarray:
    """The owner of each term: rare terms first, so that little is carried from stage to stage."""
    order = np.argsort(df, kind="stable")
    share = np.cumsum(df[order]) / max(1, df.sum())
    owner = np.zeros(len(df), np.int64)
    owner[order] = np.minimum(np.searchsorted(np.array(OWNERS), share), len(OWNERS) - 1)
    return owner


def length_norm(n: Column, n_docs: int, all_terms: int) -> Column:
    return F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {all_terms}L")


def postings(index: DataFrame, n_docs: int, all_terms: int, w: np.ndarray, owner: np.ndarray) -> DataFrame:
    """Packed postings (kind 0: term, document's place in its shard, contribution) by owner, and, for the last owner's
    stage, the doc_ids of each shard (kind 1; term 1 marks a null)."""
    last = len(OWNERS) - 1

    def make():
        def step(batch: pa.RecordBatch):
            place = batch.column(0).to_numpy()
            sizes = np.diff(batch.column(3).offsets.to_numpy())
            row = np.repeat(np.arange(len(place)), sizes)
            lists = [batch.column(k) for k in (3, 4)]
            term, tf = (x.values.to_numpy()[x.offsets[0].as_py():x.offsets[-1].as_py()].astype(np.int64) for x in lists)
            m = batch.column(2).to_numpy()[row]
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            shard, at = place >> SHARD_BITS, place & (1 << SHARD_BITS) - 1
            out = []
            order = np.lexsort((at[row], term, shard[row], owner[term]))
            o, s = owner[term][order], shard[row][order]
            new = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (s[1:] != s[:-1])])) if len(o) else []
            for a, b in zip(new, [*new[1:], len(o)]):
                x = order[a:b]
                out.append((int(o[a]), int(s[a]), 0, term[x], at[row][x], value[x]))
            ids = batch.column(1)
            null, known = np.asarray(ids.is_null()), ids.fill_null(0).to_numpy()
            for s in np.unique(shard):
                x = np.flatnonzero(shard == s)
                out.append((last, int(s), 1, null[x], at[x], known[x]))
            columns = [[r[k] for r in out] for k in range(6)]
            return columns[:3] + [pa.array([v.astype(kind) for v in c], pa.list_(pa.from_numpy_dtype(kind)))
                                  for c, kind in zip(columns[3:], (np.int32, np.int32, np.int64))]

        return step

    placed = index.select(F.monotonically_increasing_id().alias("place"), "doc_id", length_norm(F.col("n"), n_docs, all_terms).cast("bigint").alias("m"), "terms", "counts")
    return materialize(scan(placed, make, POSTINGS), "lexical-postings", ["owner"])


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    """All values of a list column."""
    parts = [c.values.to_numpy()[c.offsets[0].as_py():c.offsets[-1].as_py()] for c in column.chunks if len(c)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def stage(block: Block, owner: np.ndarray, most: np.ndarray, k: int, top: int):
    """The k-th owner's step on one shard: (bundle, postings) -> bundle, or the best documents after the last."""
    n_items, size, last = len(block.ids), 1 << SHARD_BITS, k == len(OWNERS) - 1
    first, item_of, times_of = block.first, block.item, block.times
    term_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    to_come = np.zeros(n_items, np.int64)
    later = owner[term_of] > k
    np.add.at(to_come, item_of[later], (times_of * most[term_of])[later])

    def step(bundle: pa.Table, found: pa.Table) -> pa.Table:
        own = found.filter(pc.equal(found["kind"], 0))
        term, at, value = (_flat(own[c]) for c in ("term", "at", "value"))
        order = np.argsort(term, kind="stable")
        term, at, value = term[order], at[order], value[order]
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        held_item, held_at, held_score = (_flat(bundle[c]) for c in ("item", "at", "score"))
        shard = (found if len(found) else bundle)["shard"][0].as_py()
        kept = []
        for low in range(0, n_items, ITEMS_AT_ONCE):
            here = min(ITEMS_AT_ONCE, n_items - low)
            score = np.zeros((here, size), np.int64)
            mine = (held_item >= low) & (held_item < low + here)
            score[held_item[mine] - low, held_at[mine]] = held_score[mine]
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(term)]):
                x, y = first[term[a]], first[term[a] + 1]
                x, y = x + np.searchsorted(item_of[x:y], [low, low + here])
                for item, times in zip(item_of[x:y].tolist(), times_of[x:y].tolist()):
                    # A document has a term once, so no place comes twice (repeated rows have places of their own).
                    score[item - low, at[a:b]] += value[a:b] if times == 1 else times * value[a:b]
            # What may still be among the best: not less, with all that is to come, than the shard's 20th by now.
            least = np.partition(score, size - top, axis=1)[:, size - top] if top < size else np.zeros(here, np.int64)
            i, d = np.nonzero((score > 0) & (score >= (least - to_come[low:low + here])[:, None]))
            kept.append((i + low, d, score[i, d]))
        item, place, total = (np.concatenate(x) for x in zip(*kept))
        if not last:
            columns = [[shard], *([v] for v in (item.astype(np.int32), place.astype(np.int32), total))]
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())))],
                            names=["shard", "item", "at", "score"])
        ids, null = np.zeros(size, np.int64), np.zeros(size, bool)
        given = found.filter(pc.equal(found["kind"], 1))
        where = _flat(given["at"])
        ids[where], null[where] = _flat(given["value"]), _flat(given["term"]) > 0
        order = np.lexsort((ids[place], null[place], -total, item))
        begin = np.searchsorted(item[order], np.arange(n_items))
        best = order[np.arange(len(order)) - begin[item[order]] < top]
        return pa.table([pa.array(item[best].astype(np.int32)), pa.array(ids[place[best]], mask=null[place[best]]), pa.array(total[best])],
                        names=["item", "doc_id", "score"])

    return step


def search_block(docs: DataFrame, block: Block, top: int) -> DataFrame | None:
    spark = docs.sparkSession
    index = counted(docs, block)
    n_docs, all_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    w, df, most = weights(index, n_docs, len(block.number))
    owner = owners_of(df)
    packed = postings(index, n_docs, all_terms, w, owner)
    bundles = spark.createDataFrame([], BUNDLE)
    for k in range(len(OWNERS)):
        last = k == len(OWNERS) - 1
        own = packed.where(F.col("owner") == k).drop("owner")
        step = stage(block, owner, most, k, top)
        bundles = (bundles.groupBy("shard").cogroup(own.groupBy("shard"))
                   .applyInArrow(step, schema_of(FOUND if last else BUNDLE)))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    ids = spark.createDataFrame([*enumerate(block.ids)], "item int, item_id bigint")  # a block's items
    chosen = bundles.select("*", F.row_number().over(best).alias("rank")).where(F.col("rank") <= top)
    return chosen.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The ``top`` highest-scoring documents of each item."""
    found = [materialize(x, "lexical-found") for block in blocks_of(items, block_terms) if (x := search_block(docs, block, top)) is not None]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], OUT)


SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, CAST(len(t) AS BIGINT) AS n, t FROM terms WHERE len(t) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM docs),
norm AS (SELECT d, doc_id, 75 + (25 * n * n_docs) // all_terms AS m FROM docs, whole),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM docs) GROUP BY d, term),
items AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
times AS (SELECT item_id, text, term, count(*) AS times FROM items GROUP BY item_id, text, term),
weight AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, whole WHERE term IN (SELECT term FROM times) GROUP BY term),
scored AS (SELECT item_id, text, doc_id, d, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM times JOIN weight USING (term) JOIN tf USING (term) JOIN norm USING (d) GROUP BY item_id, text, doc_id, d),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 20
"""
