"""Operator 3: personal data by weak supervision.

Candidates are the base matches (email, ip, card, phone), the matches that fail their check, and looser forms (masked and
spelled-out addresses, numbers within longer runs, without a plus or in national form, IPv6, shortened too).  Five labelers vote on each: yes, no or nothing.

* pattern: the base match holds or fails;
* gazetteer: known top-level domains, country codes, issuer digits, reserved addresses;
* context: kind words or words that speak against it just before the candidate;
* shape: lengths and grouping usual for the kind;
* edge: the candidate stands alone or within a longer token.

Spark counts the vote patterns of each kind; expectation-maximisation over these counts (a few thousand at most,
whatever the corpus) estimates the labelers' reliabilities and each pattern's posterior.  A logistic span
classifier is then trained on features of at most about ``TRAIN_ROWS`` candidates against these posteriors.  Candidates that are no
base match are added from ``ACCEPT`` on if they overlap no other span of their kind; base matches always stay.

One pass over the texts writes the candidates of each document to the shared checkpoint folder.  Results: a null or empty
text has no spans.  Positions count code points, ends are exclusive.  Repeated rows stay.  Without candidates nothing is
learned or added.  An empty table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scan, texts_of

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 5000
ACCEPT = 0.9
CONTEXT = 40

# The base patterns.  The local part of an address is read backwards from its @, and a number is
# tried from its first digit only; the matches are those of the plain patterns, in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms.
MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
NUMBER = re.compile(r"(?<![\w+.-])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
GROUPED = re.compile(r"(?<![\w-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![\w-])")
IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63})+", re.IGNORECASE | re.ASCII)
SHORT_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])")
NATIONAL = re.compile(r"(?<![\w+.-])\(?0[1-9][0-9]{0,3}\)?(?:[\x20/-][0-9]{2,8}){1,4}(?![\w-])")
DIGIT = re.compile("[0-9]")

# Gazetteers and context words.
DOMAINS = frozenset("com org net edu gov mil int info io co de fr es uk us eu it nl at ch be ca au".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "81", "82", "86", "90", "91")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2", "6011", "62", "64", "65", "35")
FOR = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel", "@"),
    "ip": ("ip", "host", "server", "address", "adresse", "addr", "login", "from"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment", "debit"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "telefon", "llama", "numéro", "+"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "part no", "section", "figure", "chapter", "build")

LABELERS = 5
CANDIDATE = "array<struct<kind:int,start:int,end:int,base:boolean,votes:int,x:array<float>>>"
ROWS = f"doc_id bigint, found {CANDIDATE}"
OUT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint, n_spans bigint"


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it holds) of the leftmost matches of each base pattern."""
    out = []
    if "@" in text:
        prior = 0
        for m in DOMAIN.finditer(text):
            start = at = m.start()
            while start > prior and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                prior = m.end()
                out.append((0, start, prior, True))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            out.append((1, *m.span(), all(map(small, m.group().split(".")))))
        for m in CARD.finditer(text):
            digits = only_digits(m.group()) if m.end() - m.start() >= 12 else ""
            if 8 <= len(digits):
                out.append((2, *m.span(), 12 <= len(digits) <= 19 and luhn(digits)))
        for m in PHONE.finditer(text):
            out.append((3, *m.span(), 9 <= len(only_digits(m.group())) <= 15))
    return out


def loose_matches(text: str) -> list[tuple[int, int, int]]:
    out = []
    low = text.lower()
    if any(k in low for k in ("[at]", "(at)")):
        out += [(0, *m.span()) for m in MASKED.finditer(text)]
    if " at " in low and " dot " in low:
        out += [(0, *m.span()) for m in SPELLED.finditer(text)]
    if "::" in text:
        out += [(1, *m.span()) for m in SHORT_IPV6.finditer(text) if m.group().count(":") < 8]
    if DIGIT.search(text):
        out += [(3, *m.span()) for m in NUMBER.finditer(text)]
        out += [(3, *m.span()) for m in NATIONAL.finditer(text) if 9 <= len(only_digits(m.group())) <= 12]
        out += [(2, *m.span()) for m in GROUPED.finditer(text) if luhn(only_digits(m.group()))]
        if text.count(":") >= 7:
            out += [(1, *m.span()) for m in IPV6.finditer(text)]
    return out


def votes_of(text: str, kind: int, start: int, end: int, holds: bool | None) -> list[int]:
    """1 for, -1 against, 0 nothing; in the order of the labelers."""
    value, digits, name = text[start:end], only_digits(text[start:end]), KINDS[kind]
    pattern = 0 if holds is None else 1 if holds else -1
    if kind == 0:
        gazetteer = 1 if re.split(r"[.\s\])]+", value.lower())[-1] in DOMAINS else -1
        shape = 1 if 6 <= len(value) <= 80 else -1
    elif kind == 1:
        first = digits and value.split(".")[0].lstrip("0")
        gazetteer = 0 if ":" in value else -1 if first in ("", "127", "255") else 1
        shape = 1 if ":" in value or all(p == "0" or p[0] != "0" for p in value.split(".")) else -1
    elif kind == 2:
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
        shape = 1 if len(digits) in (14, 15, 16) else -1
    else:
        trunk = 1 if digits[0] == "0" and digits[1] != "0" else 0
        gazetteer = (1 if digits.startswith(COUNTRY_CODES) else -1) if value[0] == "+" else trunk
        shape = 1 if 9 <= len(digits) <= 13 else -1
    before = text[max(0, start - CONTEXT):start].lower()
    context = -1 if any(w in before for w in AGAINST) else 1 if any(w in before for w in FOR[name]) else 0
    around = text[max(0, start - 1):start] + text[end:end + 1]
    edge = -1 if any(c.isalnum() or c in "_/\\" for c in around) else 1
    return [pattern, gazetteer, context, shape, edge]


def features(text: str, kind: int, start: int, end: int, votes: list[int]) -> list[float]:
    value = text[start:end]
    digits = len(only_digits(value))
    letters = sum(c.isalpha() for c in value)
    marks = [value.count(c) for c in " -.()@+:"]
    near = [float(text[max(0, start - 1):start].isspace() or start == 0), float(text[end:end + 1].isspace() or end == len(text))]
    return [
        1.0, *(float(kind == k) for k in range(4)), *(float(v == 1) for v in votes), *(float(v == -1) for v in votes),
        min(len(value), 64) / 32, min(digits, 32) / 16, letters / max(1, len(value)), *(min(m, 4) / 2 for m in marks), *near,
    ]


def pack_votes(votes: list[int]) -> int:
    return sum((v + 1) * 3**k for k, v in enumerate(votes))


def unpack_votes(number: int) -> list[int]:
    return [number // 3**k % 3 - 1 for k in range(LABELERS)]


def candidates(text: str) -> list[dict]:
    base = base_matches(text)
    rows = [(k, s, e, h, h) for k, s, e, h in base]
    held = [(k, s, e) for k, s, e, h in base if h]
    for k, s, e in loose_matches(text):
        if not any(a < e and s < b for kk, a, b in held if kk == k):
            rows.append((k, s, e, False, None))
    out = []
    for kind, s, e, is_base, holds in rows:
        votes = votes_of(text, kind, s, e, holds)
        out.append({"kind": kind, "start": s, "end": e, "base": is_base, "votes": pack_votes(votes), "x": features(text, kind, s, e, votes)})
    return out


@dataclass
class Reliability:
    """P(vote | personal or not, the labeler votes) for each kind and labeler, and the prior of each kind."""

    table: np.ndarray  # kind, personal, labeler, vote against or for
    prior: np.ndarray

    def posterior(self, kind: int, votes: list[int]) -> float:
        own = [np.prod([self.table[kind, c, k, int(v > 0)] for k, v in enumerate(votes) if v]) for c in (0, 1)]
        p = self.prior[kind]
        return float(p * own[1] / max(p * own[1] + (1 - p) * own[0], 1e-300))


def estimate(counts: dict[tuple[int, int], int], rounds: int = 100) -> Reliability:
    """EM over (kind, packed votes) -> count, from the majority of the votes; counts are smoothed by one, and a
    labeler that doesn't vote says nothing."""
    table, prior = np.full((4, 2, LABELERS, 2), 0.5), np.full(4, 0.5)
    for kind in range(4):
        rows = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        if not rows:
            continue
        votes = np.array([unpack_votes(v) for v, _ in rows])
        n = np.array([n for _, n in rows], float)
        weight = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
        for _ in range(rounds):
            for c, w in ((1, weight * n), (0, (1 - weight) * n)):
                for k in range(LABELERS):
                    own = np.bincount(votes[:, k] + 1, weights=w, minlength=3)[[0, 2]] + 1
                    table[kind, c, k] = own / own.sum()
            prior[kind] = (weight @ n + 1) / (n.sum() + 2)
            new = np.array([Reliability(table, prior).posterior(kind, v) for v in votes])
            if np.abs(new - weight).max() < 1e-7:
                break
            weight = new
    return Reliability(table, prior)


def fit_spans(x: np.ndarray, target: np.ndarray, n: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels of rows that stand for ``n`` candidates each (Newton steps)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (n * (p - target)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray | None:
    found = rows.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    counts = {(r["kind"], r["votes"]): r["n"] for r in found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    reliability = estimate(counts)
    # Candidates that are no base match are few; both sorts have a draw of their own.
    n = {r["base"]: r["count"] for r in found.groupBy("base").count().collect()}
    draw = F.pmod(F.xxhash64("doc_id", "start", "kind"), F.lit(1 << 30))
    limit = F.when(F.col("base"), F.lit(int((1 << 30) * min(1, train_rows / 2 / n.get(True, 1))))).otherwise(F.lit(int((1 << 30) * min(1, train_rows / 2 / n.get(False, 1)))))
    drawn = found.where(draw < limit).groupBy("kind", "votes", "x").count().collect()
    drawn.sort(key=lambda r: (r["kind"], r["votes"], list(r["x"])))
    x = np.array([r["x"] for r in drawn], float)
    target = np.array([reliability.posterior(r["kind"], unpack_votes(r["votes"])) for r in drawn])
    return fit_spans(x, target, np.array([r["count"] for r in drawn], float))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_personal(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            return [batch.column(0), [candidates(t) for t in texts_of(batch)]]

        return step

    rows = materialize(scan(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), make, ROWS), "personal-candidates")
    model = train(rows)

    def make_spans():
        def step(batch: pa.RecordBatch):
            out = []
            for found in batch.column(1).to_pylist():
                base = [(f["start"], f["kind"], f["end"]) for f in found if f["base"]]
                taken, added = list(base), []
                for f in found:
                    if f["base"] or model is None or 1 / (1 + np.exp(-np.dot(f["x"], model))) < accept:
                        continue
                    if not any(k == f["kind"] and s < f["end"] and f["start"] < e for s, k, e in taken):
                        added.append((f["start"], f["kind"], f["end"]))
                        taken.append(added[-1])
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                out.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(taken), len(added), len(taken)))
            return [batch.column(0), *([r[k] for r in out] for k in range(8))]

        return step

    return scan(rows, make_spans, OUT)
