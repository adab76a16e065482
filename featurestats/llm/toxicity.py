"""Operator 1: toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a logistic score over its words and their stems (the first
``STEM`` letters); the document's score is their noisy-or, 1 - prod(1 - p), so one bad sentence is enough and the sentences that make it so can be named.  Only document
labels are used for training: the gradient of the document's log-likelihood reaches each sentence through the noisy-or.

Training rows are drawn by a hash of the id, at most about ``TRAIN_ROWS`` of each label, among labelled rows that aren't
held out, long ones like others; weights restore the labels' shares in the corpus.  The driver holds their known words, at
most about ``TRAIN_WORDS``: were there more, the draw would be smaller.  The
vocabulary is the ``WORDS`` words and stems whose document frequencies differ most between the labels, by ``MIN_Z`` standard errors
at least (counted by Spark).

Sentences end at . ! ? or a line feed and after ``SENTENCE`` words.  Results: a text without words (null, empty) scores 0;
without rows of both labels everything scores 0.  A null doc_id is held in and never learned from.  An id labelled more than once has its
largest label; of rows that repeat an id, one is learned from and all are scored.  An empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, fold, materialize, scan, texts_of

TRAIN_ROWS = 4000
TRAIN_WORDS = 20_000_000
WORDS = 5000
MIN_DOCS = 4
MIN_Z = 3.0
RIDGE = 0.1
SENTENCE = 32
STEM = 4
TOXIC = 0.7
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
BREAKS = frozenset(".!?\n")
OUT = "doc_id bigint, held_out boolean, score double, predicted int, sentences string"


@dataclass
class Model:
    words: dict[str, int]  # a stem is written with a star
    weights: np.ndarray  # of the words and stems, then 0 for any other word, then 0 for a break
    bias: float


def stem(word: str) -> str:
    return word[:STEM] + "*"


def bags(texts: list[str], words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the words and, below them, of their stems; where each sentence begins; text of each sentence).

    A sentence begins with a break (number len(words) + 1); what is unknown has number len(words)."""
    n = len(words)
    known = words | dict.fromkeys(BREAKS, n + 1)
    flat, stems, sizes = [], [], []
    for text in texts:
        tokens = TOKEN.findall(text.lower())
        flat.append(n + 1)
        flat.extend(map(known.get, tokens, repeat(n)))
        stems.append(n)
        stems.extend(map(words.get, map(stem, tokens), repeat(n)))
        sizes.append(len(tokens) + 1)
    ids = np.array([flat, stems], np.int64)
    begin = np.flatnonzero(ids[0] == n + 1)
    at = np.arange(len(flat)) - np.repeat(begin, np.diff(np.append(begin, len(flat))))
    # Word 1 to SENTENCE after a break, then the next ones; the break itself goes with the first.
    starts = np.flatnonzero((at == 0) | ((at > 1) & (at % SENTENCE == 1)))
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    return ids, starts, owner


def sentence_logits(ids: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """The logit of each sentence; -inf for one without words."""
    size = np.diff(np.append(starts, ids.shape[1]))
    empty = (size == 1) & (ids[0, starts] == len(model.words) + 1)
    return np.where(empty, -np.inf, np.add.reduceat(model.weights[ids].sum(0), starts) + model.bias)


def noisy_or(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - sigmoid(logit)) over each owner's sentences."""
    return -np.expm1(-np.bincount(owner, weights=np.logaddexp(0, logits), minlength=n))


def fit(word: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, weights: np.ndarray, words: dict[str, int], steps: int = 300, rate: float = 0.1, ridge: float = RIDGE) -> Model:
    """Adam on the weighted mean log-likelihood of the labels, less ridge / rows * weights ** 2 / 2.

    ``word`` and ``sentence`` pair each known word with its sentence, ``owner`` is the document of each sentence."""
    n, v, m_sentences = len(labels), len(words), len(owner)
    ridge = ridge / n
    w, bias = np.zeros(v), -5.0
    m, s = np.zeros(v + 1), np.zeros(v + 1)
    for t in range(1, steps + 1):
        logits = np.bincount(sentence, weights=w[word], minlength=m_sentences) + bias
        total = np.maximum(np.bincount(owner, weights=np.logaddexp(0, logits), minlength=n), 1e-12)
        # d loss / d total: 1 for label 0; for label 1 the loss is -log(1 - exp(-total)).
        slope = np.where(labels == 1, -1 / np.expm1(np.minimum(total, 500)), 1.0) * weights
        d = slope[owner] / (1 + np.exp(-np.clip(logits, -500, 500)))
        g = np.concatenate([np.bincount(word, weights=d[sentence], minlength=v) + ridge * w, [d.sum()]])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w = w - step[:-1]
        bias = max(bias - step[-1], -14.0)
    return Model(words, np.concatenate([w, [0.0, 0.0]]), float(bias))


def known_words(text: str, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, sentence) of each known word or stem of a text, and how many sentences have words at all."""
    ids, starts, _ = bags([text], words)
    size = np.diff(np.append(starts, ids.shape[1]))
    filled = (size > 1) | (ids[0, starts] != len(words) + 1)
    place = np.repeat(np.cumsum(filled) - 1, size)
    own = ids < len(words)
    return ids[own].astype(np.int32), np.stack([place, place])[own].astype(np.int32), int(filled.sum())


def train(docs: DataFrame, labels: DataFrame, fold_mod: int = 3, held_out: int = 1, per_label: int = TRAIN_ROWS,
          max_words: int = TRAIN_WORDS) -> Model | None:
    known = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
             .where(fold("doc_id", fold_mod) != held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    limit = F.when(F.col("toxic") == 1, F.lit(int((1 << 30) * min(1, per_label / counts[1])))).otherwise(F.lit(int((1 << 30) * min(1, per_label / counts[0]))))
    drawn = known.where(draw < limit)  # about 2 * per_label rows of 12 bytes
    # Written once: the documents are read for it once, and of rows that repeat an id always the same is learned from.
    texts = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.length("text") > 0)
             .join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "toxic")).alias("row")).select("doc_id", "row.*"))
    texts = materialize(texts, "toxicity-rows")

    def make():
        def step(batch: pa.RecordBatch):
            rows = []
            for text, y in zip(texts_of(batch), batch.column(1).to_pylist()):
                words = set(TOKEN.findall(text.lower())) - BREAKS
                rows.append((y, sorted(words | {stem(w) for w in words})))
            return [[y for y, ws in rows for _ in ws], [w for _, ws in rows for w in ws]]

        return step

    spread = scan(texts.select("text", "toxic"), make, "toxic int, word string")
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    p0, p1, p = F.col("c0") / n[0], F.col("c1") / n[1], (F.col("c0") + F.col("c1")) / (n[0] + n[1])
    apart = F.abs(p1 - p0) / F.sqrt((p * (1 - p) + F.lit(1e-9)) * (1 / n[0] + 1 / n[1]))
    top = (spread.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("c0"), F.sum("toxic").alias("c1"))
           .where(F.col("c0") + F.col("c1") >= MIN_DOCS).where(apart >= MIN_Z).orderBy(apart.desc(), "word").limit(WORDS).select("word").collect())
    words = {r["word"]: k for k, r in enumerate(top)}

    def make_bags():
        def step(batch: pa.RecordBatch):
            rows = [known_words(t, words) for t in texts_of(batch)]
            return [batch.column(0), batch.column(1), [r[0].tobytes() for r in rows], [r[1].tobytes() for r in rows], [r[2] for r in rows]]

        return step

    # The known words alone, 8 bytes each.
    found = materialize(scan(texts.select("doc_id", "toxic", "text"), make_bags, "doc_id bigint, toxic int, words binary, places binary, sentences int"), "toxicity-bags")
    held = found.agg(F.sum(F.octet_length("words") / 4)).first()[0] or 0
    if held > max_words:
        found = found.where(F.pmod(F.xxhash64(F.lit("words"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_words / held))
    rows = found.collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows])
    n_sentences = np.array([r["sentences"] for r in rows])
    offsets = np.cumsum(n_sentences) - n_sentences
    word = np.concatenate([np.frombuffer(r["words"], np.int32) for r in rows])
    sentence = np.concatenate([np.frombuffer(r["places"], np.int32) + o for r, o in zip(rows, offsets)])
    owner = np.repeat(np.arange(len(rows)), n_sentences)
    share = counts[1] / (counts[0] + counts[1])
    weights = np.where(y == 1, share / max((y == 1).mean(), 1e-9), (1 - share) / max((y == 0).mean(), 1e-9)) / len(y)
    return fit(word, sentence, owner, y, weights, words)


def spans(text: str, model: Model, least: float) -> str:
    """start:end of the sentences with a score of ``least`` or more, in code points of the text."""
    low = text.lower()
    if len(low) != len(text):  # letters whose lower case is longer: keep them, so that places hold
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    found, begin, end, z, n = [], 0, 0, model.bias, 0

    def close():
        if n and 1 / (1 + np.exp(-z)) >= least:
            found.append(f"{begin}:{end}")

    for m in TOKEN.finditer(low):
        stop = m.group() in BREAKS
        if stop or n == SENTENCE:
            end = m.end() if stop else end
            close()
            z, n = model.bias, 0
        if not stop:
            begin = m.start() if n == 0 else begin
            end, n = m.end(), n + 1
            z += sum(model.weights[model.words.get(x, len(model.words))] for x in (m.group(), stem(m.group())))
    close()
    return ",".join(found)


def score(docs: DataFrame, model: Model | None, fold_mod: int = 3, held_out: int = 1, threshold: float = TOXIC) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            texts = texts_of(batch)
            scores = np.zeros(len(texts))
            for a, b in chunks(texts) if model else ():
                ids, starts, owner = bags(texts[a:b], model.words)
                scores[a:b] = noisy_or(sentence_logits(ids, starts, model), owner, b - a)
            named = [spans(t, model, 0.5) if s >= threshold else "" for t, s in zip(texts, scores)]
            return [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), named]

        return step

    held = F.coalesce(fold("doc_id", fold_mod) == held_out, F.lit(False)).alias("held_out")
    return scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text"), make, OUT)
