"""Operator 9: benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased.  Documents and benchmark items are joined on seeds of ``MIN_MATCH`` words.
Seeds that many items share (a common opening) are left out of the join as long as they alone cannot cover enough of
an item (``triggers``): a leak of it must have another seed too, so nothing is lost and a hot seed does not pair every document
with every item.  Of a pair, the item's words within shared seeds bound what tiles can cover; only pairs within reach are tiled.

Tiles are marked in both texts by running Karp-Rabin: for a falling search length, windows of unmarked words are matched by
rolling hash; the diagonals they lie on are compared word by word, and their runs marked from the longest on without overlap,
the rest of a run that a tile cuts coming back shortened.  A diagonal is compared once for a search length, however many windows
match on it, so repeated words cost no more than document times item.  A pair is a leak if the tiles cover ``COVERAGE`` of the
item's words, in whatever order the passages stand.

The benchmark is a query set held against all documents in blocks of about ``BLOCK_CHARS`` characters (its size is
counted first).  The driver and a task hold one block at a time; each block's leaks are written before the next is read.

Results: items of fewer than MIN_MATCH words, null or empty ones included, can't be found; repeated items with one id and text
count once; null or empty texts match nothing; repeated documents each give their rows.  Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, code_points, materialize, mix64, scan, texts_of

MIN_MATCH = 4
COVERAGE = 0.5
BLOCK_CHARS = 8 << 20
OUT = "doc_id bigint, item_id bigint, coverage double, n_tiles bigint, tiled_words bigint, longest_tile bigint"

_random = np.random.default_rng(9)
_AT = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _random.integers(0, 1 << 63, MIN_MATCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
#: Items that share a seed from which on it counts as hot.
HOT = 8
#: Window pairs that are told apart; beyond that all diagonals are compared.
PAIRS = 1 << 20
#: Words compared at a time.
CELLS = 1 << 22
#: Stand for words that a tile has taken, in a document and in an item.
TAKEN, GIVEN = np.uint64(0), np.uint64(1)


def word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def word_hashes(texts: list[str], in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a 64-bit hash of each word of all texts, where each text's words begin, and the end)."""
    flat, bounds = code_points([t.lower() + "\n" for t in texts])
    inside = in_word[flat]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    chars = flat[inside].astype(np.uint64)
    first = np.flatnonzero(begins[inside])
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    at = np.arange(len(chars)) - np.repeat(first, np.diff(np.append(first, len(chars))))
    chars += np.uint64(1)
    chars *= _AT[at & 255]
    hashes = mix64(np.add.reduceat(chars, first))
    return hashes, np.searchsorted(np.flatnonzero(begins), bounds)


def seeds(words: np.ndarray) -> np.ndarray:
    """A hash of each run of MIN_MATCH words (runs that cross texts included)."""
    n = len(words) - MIN_MATCH + 1
    return reduce(np.add, (words[k:n + k] * _STEP[k] for k in range(MIN_MATCH))) if n > 0 else words[:0]


class Items:
    """A block of the benchmark: words of each item, its seeds, and an index of the seeds that make a pair."""

    def __init__(self, rows: list[tuple[int | None, str]], coverage: float = COVERAGE):
        rows = sorted({(i, t) for i, t in rows if t}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        words, first = word_hashes([t for _, t in rows], word_table())
        self.ids = [i for i, _ in rows]
        self.words = [words[a:b] for a, b in zip(first, first[1:])]
        #: Of each item, the seed at each of its positions.
        self.seeds = [seeds(w) for w in self.words]
        seed = np.concatenate([*self.seeds, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(rows)), [len(s) for s in self.seeds])
        pair = self.triggers(seed, owner, coverage)
        order = np.lexsort((owner[pair], seed[pair]))
        self.seed, self.owner = seed[pair][order], owner[pair][order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.slot(seed)] = True

    def triggers(self, seed: np.ndarray, owner: np.ndarray, coverage: float) -> np.ndarray:
        """Places of the seeds to join on, one for each seed of an item: all but the hottest of it that cannot cover enough."""
        order = np.lexsort((owner, seed))
        s, o = seed[order], owner[order]
        one = order[np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])])] if len(s) else order
        value, place, count = np.unique(seed[one], return_inverse=True, return_counts=True)
        shared = count[place]
        keep = np.ones(len(one), bool)
        hot: dict[int, list[int]] = {}
        for k in np.flatnonzero(shared >= HOT).tolist():
            hot.setdefault(int(owner[one[k]]), []).append(k)
        for item, mine in hot.items():
            reached = np.zeros(len(self.words[item]), bool)
            for k in sorted(mine, key=lambda k: -shared[k]):
                at = np.flatnonzero(self.seeds[item] == seed[one[k]])
                more = reached.copy()
                more[(at[:, None] + np.arange(MIN_MATCH)).ravel()] = True
                if more.sum() >= coverage * len(more):
                    break
                reached, keep[k] = more, False
        return one[keep]

    @staticmethod
    def slot(seed: np.ndarray) -> np.ndarray:
        return (seed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position in ``words``, seed) of the seeds of each text that some item may hold, by text and seed."""
        own = seeds(words)
        pos = np.flatnonzero(self.filter[self.slot(own)])
        text = np.searchsorted(first, pos, "right") - 1
        inside = pos + MIN_MATCH <= first[text + 1] if len(pos) else np.zeros(0, bool)
        pos, text = pos[inside], text[inside]
        order = np.lexsort((pos, own[pos], text))
        return text[order], pos[order], own[pos[order]]

    def pairs(self, seed: np.ndarray) -> np.ndarray:
        """The items that a text with these (sorted, distinct) seeds is paired with."""
        low, high = (np.searchsorted(self.seed, seed, side) for side in ("left", "right"))
        size = high - low
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.unique(self.owner[np.repeat(low, size) + offset])


def _windows(words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of the ``size`` words from each start on, from one running sum of word * base ** position."""
    power = np.full(len(words) + 1, _BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * power[:-1])])
    return (total[starts + size] - total[starts]) * power[len(words) - starts]


def tiles(doc: np.ndarray, item: np.ndarray, doc_starts: np.ndarray, item_starts: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc position, item position, length); every match begins at one of the starts (shared seeds)."""
    # The usual case is the longest there can be: the item as a whole.
    x, y = _equal_windows(doc, item, doc_starts, item_starts[item_starts == 0], len(item))
    for at in x[:1].tolist():
        if np.array_equal(doc[at:at + len(item)], item):
            return [(at, 0, len(item))]
    doc, item = doc.copy(), item.copy()
    found: list[tuple[int, int, int]] = []
    size = min_match
    while size * 2 <= len(item):
        size *= 2
    while True:
        for d, i, n in _longest_first(*_runs(doc, item, doc_starts, item_starts, size), size):
            doc[d:d + n], item[i:i + n] = TAKEN, GIVEN
            found.append((d, i, n))
        if size == min_match or (item != GIVEN).sum() < min_match:
            return found
        size = max(min_match, size // 2)


def _equal_windows(doc, item, doc_starts, item_starts, size) -> tuple[np.ndarray, np.ndarray | None]:
    """Starts of the ``size``-word windows of both sides with equal hashes: in pairs, or (document starts, None) where there
    would be more than ``PAIRS``."""
    d, i = doc_starts[doc_starts + size <= len(doc)], item_starts[item_starts + size <= len(item)]
    if not len(d) or not len(i):
        return d[:0], i[:0]
    have, want = _windows(doc, d, size), _windows(item, i, size)
    # The base's powers make both comparable from their own end; align item windows to the document's.
    want = want * _BASE_POWER(len(doc) - len(item)) if len(doc) >= len(item) else want
    have = have * _BASE_POWER(len(item) - len(doc)) if len(item) > len(doc) else have
    order = np.argsort(want, kind="stable")
    low, high = (np.searchsorted(want[order], have, side) for side in ("left", "right"))
    count = high - low
    if count.sum() > PAIRS:
        return d[count > 0], None
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(d, count), i[order[np.repeat(low, count) + offset]]


def _runs(doc, item, doc_starts, item_starts, size) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc position, item position, length) of the maximal runs of equal unmarked words, of ``size`` at least."""
    x, y = _equal_windows(doc, item, doc_starts, item_starts, size)
    m = len(item)
    if y is not None:
        diagonals = np.unique(x - y)
    else:  # all that begin within an item's length of a start
        near = np.zeros(len(doc) + m, np.int64)
        np.add.at(near, x, 1)
        np.add.at(near, x + m, -1)
        diagonals = np.flatnonzero(np.cumsum(near) > 0) - (m - 1)
    padded = np.concatenate([np.full(m - 1, TAKEN), doc, np.full(m - 1, TAKEN)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, m)
    out = []
    for k in range(0, len(diagonals), max(1, CELLS // m)):
        part = diagonals[k:k + max(1, CELLS // m)]
        part = part[part + m - 1 < len(rows)]
        same = np.zeros((len(part), m + 2), np.int8)
        same[:, 1:-1] = rows[part + m - 1] == item
        edge = np.diff(same, axis=1)
        row, begin = np.nonzero(edge == 1)
        n = np.nonzero(edge == -1)[1] - begin
        long = n >= size
        out.append((part[row[long]] + begin[long], begin[long], n[long]))
    x, y, n = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return x, y, n


def _longest_first(x: np.ndarray, y: np.ndarray, n: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Runs from the longest on, leftmost on ties; what a chosen one takes is cut out of the others."""
    while len(n):
        best = np.flatnonzero(n == n.max())
        best = best[np.lexsort((y[best], x[best]))[0]]
        a, b, k = int(x[best]), int(y[best]), int(n[best])
        yield a, b, k
        # Of each run: [0, n) less where the document's words go, less where the item's go.
        cuts = []
        for at, start in ((x, a), (y, b)):
            low, high = np.clip(start - at, 0, n), np.clip(start + k - at, 0, n)
            none = low >= high
            cuts.append((np.where(none, n, low), np.where(none, n, high)))
        (low1, high1), (low2, high2) = cuts
        first, last = np.minimum(low1, low2), np.maximum(high1, high2)
        # With both cuts there may be a piece between them; with one, it ends where the other would begin.
        swap = low1 > low2
        middle_low, middle_high = np.where(swap, high2, high1), np.where(swap, low1, low2)
        pieces = [(np.zeros_like(n), first), (middle_low, middle_high), (last, n)]
        # A cut at n is none: then the piece after the other one is in the middle, up to n, and the last is empty.
        low, high = (np.concatenate([p[c] for p in pieces]) for c in (0, 1))
        x, y = np.tile(x, 3) + low, np.tile(y, 3) + low
        n = high - low
        keep = n >= size
        x, y, n = x[keep], y[keep], n[keep]


def _BASE_POWER(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def leaks_of(texts: list[str], items: Items, in_word: np.ndarray, coverage: float):
    """(index of the text, item id, coverage, tiles, tiled words, longest tile) of each leak."""
    words, first = word_hashes(texts, in_word)
    text, pos, seed = items.hits(words, first)
    bounds = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else []
    for a, b in zip(bounds, [*bounds[1:], len(text)] if len(text) else []):
        mine = seed[a:b]
        distinct = mine[np.concatenate([[True], mine[1:] != mine[:-1]])]
        begin, end = first[text[a]], first[text[a] + 1]
        for item in items.pairs(distinct).tolist():
            target, own = items.words[item], items.seeds[item]
            item_starts = np.flatnonzero(_among(own, distinct))
            reach = np.zeros(len(target) + 1, np.int64)
            np.add.at(reach, item_starts, 1)
            np.add.at(reach, item_starts + MIN_MATCH, -1)
            if (np.cumsum(reach) > 0).sum() < coverage * len(target):
                continue  # tiles lie within shared seeds, so they can't cover enough
            doc_starts = np.sort(pos[a:b][_among(mine, np.unique(own[item_starts]))]) - begin
            found = tiles(words[begin:end], target, doc_starts, item_starts)
            covered = sum(n for _, _, n in found)
            if covered >= coverage * len(target):
                yield int(text[a]), items.ids[item], covered / len(target), len(found), covered, max(n for _, _, n in found)


def _among(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which values are among ``held`` (sorted, not empty)."""
    return held[np.minimum(np.searchsorted(held, values), len(held) - 1)] == values


class Blocks:
    """The benchmark in blocks of about ``block_chars`` characters, each read when its turn comes."""

    def __init__(self, benchmark: DataFrame, block_chars: int, coverage: float):
        self.rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL").distinct()
        chars = self.rows.agg(F.sum(F.length("text"))).first()[0] or 0
        self.n, self.coverage = -(-chars // block_chars), coverage

    def __len__(self) -> int:
        return self.n

    def __iter__(self) -> Iterator[Items]:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(self.n, 1)))
        for k in range(self.n):
            yield Items([(r["item_id"], r["text"]) for r in self.rows.where(block == k).collect()], self.coverage)


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, coverage: float = COVERAGE) -> Blocks:
    return Blocks(benchmark, block_chars, coverage)


def find_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and benchmark item it holds."""
    texts = docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text")

    def against(items: Items) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def make():
            in_word = word_table()

            def step(batch: pa.RecordBatch):
                rows, ids = texts_of(batch), batch.column(0).to_pylist()
                found = [(ids[a + x[0]], *x[1:]) for a, b in chunks(rows) for x in leaks_of(rows[a:b], shared.value, in_word, coverage)]
                return [[x[k] for x in found] for k in range(6)]

            return step

        return scan(texts, make, OUT)

    blocks = blocks_of(benchmark)
    # One block's leaks need no table of their own.
    found = [against(items) if len(blocks) == 1 else materialize(against(items), "leaks") for items in blocks]
    return reduce(DataFrame.unionByName, found) if found else texts.sparkSession.createDataFrame([], OUT)


def without_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item."""
    blocks = blocks_of(benchmark)
    for items in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            in_word = word_table()
            for batch in batches:
                texts = texts_of(batch)
                bad = {a + x[0] for a, b in chunks(texts) for x in leaks_of(texts[a:b], shared.value, in_word, coverage)}
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if len(blocks) > 1:
            docs = materialize(docs, "without-leaks")
    return docs
