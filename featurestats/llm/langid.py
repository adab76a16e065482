"""Operator 7: language identification by rank-order profiles.

The profile of a language ranks its most frequent character n-grams (1 to 3 characters, words padded with a blank);
so does the profile of a document.  The out-of-place distance adds, over the document's ranked n-grams, how far each
stands from its place in the language's profile (``PROFILE`` places if it isn't in there); the nearest language wins,
the alphabetically first on a tie.  ``score`` is 1 - distance / (the largest possible distance).

Profiles are learned from a sample of labelled rows: at most about ``per_lang`` rows of each language, chosen by a hash
of id and text.  Counting is distributed; the driver gets ``PROFILE`` rows for each language.

Results: ``und`` with score 0 if the text is null or has no letter, or nothing was learned.  A null doc_id is held in, but
never learned from.  Repeated rows stay.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, scan

PROFILE = 300
SAMPLE_ROWS = 4000
UNKNOWN = "und"
OUT = "doc_id bigint, held_out boolean, lang_pred string, score double"
_BLANK = np.uint64(32)


class Grams:
    """N-grams of a text as sorted distinct numbers (21 bits a character) with counts."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of what is between words, one sign stays
        s = np.where(letter, points, _BLANK)[keep].astype(np.uint64)
        s = np.concatenate([[_BLANK], s, [_BLANK]])
        two = s[:-1] << np.uint64(21) | s[1:]
        three = (two[:-1] << np.uint64(21) | s[2:])[s[1:-1] != _BLANK]
        two = two[(s[:-1] != _BLANK) | (s[1:] != _BLANK)]
        grams = np.concatenate([s[s != _BLANK], two, three])
        grams.sort()
        if not len(grams):
            return grams, np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.diff(np.append(first, len(grams)))

    def ranked(self, text: str, size: int) -> np.ndarray:
        """The ``size`` most frequent n-grams, most frequent first; ties by number."""
        grams, counts = self(text)
        return grams[np.argsort(-counts, kind="stable")[:size]]


def learn_profiles(docs: DataFrame, fold_mod: int = 5, held_out: int = 0, per_lang: int = SAMPLE_ROWS, size: int = PROFILE) -> dict[str, list[int]]:
    """lang -> its n-grams by rank, from rows that have a text and a lang and aren't held out."""
    rows = docs.select("doc_id", "text", "lang").where(f"text IS NOT NULL AND lang IS NOT NULL AND lang <> '{UNKNOWN}'").where(fold("doc_id", fold_mod) != held_out)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int((1 << 30) * min(1.0, per_lang / n)))))

    def make():
        grams = Grams()

        def step(batch: pa.RecordBatch):
            total: dict[str, dict[int, int]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = total.setdefault(lang, {})
                for g, n in zip(*(x.tolist() for x in grams(text))):
                    mine[g] = mine.get(g, 0) + n
            flat = [(lang, g, n) for lang, mine in total.items() for g, n in mine.items()]
            return [[r[i] for r in flat] for i in range(3)]

        return step

    counted = scan(rows.where(draw < limits[F.col("lang")]).select("text", "lang"), make, "lang string, gram bigint, n bigint")
    totals = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    top = totals.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size, self.grams = sorted(profiles), size, Grams()
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.uint64))
        self.place = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.known, np.array(profiles[lang], np.uint64)), k] = np.arange(len(profiles[lang]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = self.grams.ranked(text, self.size) if text and self.langs else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[self.known[np.minimum(at, len(self.known) - 1)] != own] = len(self.known)
        place = self.place[at]
        apart = np.where(place < 0, self.size, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(own))


def identify(docs: DataFrame, profiles: dict[str, list[int]], fold_mod: int = 5, held_out: int = 0) -> DataFrame:
    def make():
        classify = Classifier(profiles)

        def step(batch: pa.RecordBatch):
            found = [classify(t) for t in batch.column(2).to_pylist()]
            return [batch.column(0), batch.column(1), [f[0] for f in found], [f[1] for f in found]]

        return step

    held = F.coalesce(fold("doc_id", fold_mod) == held_out, F.lit(False)).alias("held_out")
    return scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held, "text"), make, OUT)


def reject_unidentified(docs: DataFrame, profiles: dict[str, list[int]], min_score: float) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is known with at least ``min_score``."""

    def run(batches):
        classify = Classifier(profiles)
        for batch in batches:
            found = [classify(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


