"""Operator 8: secret scan by a character convolutional network over every candidate.

Base findings (three patterns) always stay.  Other candidates are runs of ``[A-Za-z0-9+/_=-]`` of 16 characters or more that
hold a digit and a letter, less what base findings cover (what is left of a run that a base finding touches is scored at any
length), and failing matches with a digit and a letter.  The network reads each candidate with the characters around it.  It learns from
labelled findings: base findings are secrets; near misses (long numbers, long plain words, failing matches that touch neither a base
finding nor a candidate run) are not; other candidates are not labelled.  A long finding is read by several windows, all of one
label.  All of them are learnt from: Spark keeps the windows in shards of about ``TRAIN_ROWS`` of each label, each with as many
rewritten ones, tasks train on their shards, and the means of their networks begin the next round.  Equal windows count once.  A
quarter, by a hash, is kept from training; all of it calibrates the score and, with the rewritten secrets as networks see them that were
trained without their form, sets the highest threshold that still recalls ``RECALL`` of the secrets; a precision under
``FLOOR`` there is warned of.  Candidates at or over it are added; their kind follows their shape (hex, access, else assign).

One pass over the texts writes a row for each document with its findings to the shared checkpoint folder; training and
scoring read that.

Results: positions count code points, ends are exclusive, a span is the whole match.  A null or empty text has no spans
(base_sha256 of '').  Repeated rows stay.  An empty table gives no rows.  Without labelled findings of both kinds
nothing is added.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .charcnn import BEFORE, STEP, WIDTH, CharCnn, balanced, encode_window
from .common import materialize, scan, schema_of, texts_of

# The patterns of the base findings.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
PLAIN = 3  # in place of a kind: a long plain word
LEAST = {"assign": 6, "access": 20, "hex": 24}

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
WORD = re.compile(r"[^\W\d_]{12,}")
#: Windows of each label, and plain words, that a shard has, about.
TRAIN_ROWS, WORD_ROWS = 2000, 100_000
#: Rounds of training: each goes over a shard's windows once, and over the next part of its plain words.
ROUNDS = 12
#: What a plain word weighs: there are many, and they are easy.
WORD_WEIGHT = 1 / 64
#: Logits are counted in steps of this fraction.
BINS = 1024
RECALL = 0.98
#: Rewritten windows of each label for a window of ``TRAIN_ROWS``, and by default.
REWRITTEN_SHARE, REWRITTEN = 0.8, 1600
FORMS = ("value", "short", "base62", "upper", "marked", "vendor")
FLOOR = 0.5
FINDING = "array<struct<label:int,open:boolean,kind:int,start:int,end:int,length:int,codes:binary>>"
ROWS = f"doc_id bigint, base array<struct<kind:int,start:int,end:int>>, findings {FINDING}"
OUT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"


def base_and_misses(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((start, kind, end) of base findings; (start, end) of failing matches)."""
    found, missed = [], []

    def take(kind: int, start: int, end: int, size: int):
        if size >= LEAST[KINDS[kind]]:
            found.append((start, kind, end))
        else:
            missed.append((start, end))

    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            take(0, m.start(), m.end(), m.end(2) - m.start(2))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            take(1, m.start(), m.end(), m.end() - m.start())
    for m in HEX.finditer(text):
        take(2, m.start(), m.end(), m.end() - m.start())
    return sorted(found), missed


def kind_of(value: str) -> int:
    if value.startswith("AKIA"):
        return 1
    return 2 if re.fullmatch("[0-9a-f]+", value) else 0


_DIGIT = re.compile("[0-9]")


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, sorted, with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of start:end that none of the spans (of ``unite``) covers."""
    parts, k = [], max(bisect_right(taken, (start, start)) - 1, 0)
    while start < end and k < len(taken) and taken[k][0] < end:
        a, b = taken[k]
        if start < a:
            parts.append((start, a))
        start, k = max(start, b), k + 1
    return parts + [(start, end)] if start < end else parts


def findings(text: str) -> tuple[list, list]:
    """(base, findings to learn from or to score): label 1 secret, 0 none, None unknown; open ones are scored."""
    base, missed = base_and_misses(text)
    taken = unite([(s, e) for s, _, e in base])
    rows = [(1, False, k, s, e) for s, k, e in base]
    runs = []
    if _DIGIT.search(text):
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            if not _DIGIT.search(text, s, e):
                continue
            parts = outside(s, e, taken)
            if parts == [(s, e)] and not any(c.isalpha() for c in m.group()):
                rows.append((0, False, 0, s, e))
                continue
            runs.append((s, e))
            rows += [(None, True, kind_of(text[a:b]), a, b) for a, b in parts if any(c.isalnum() for c in text[a:b])]
        # Plain words stand for all that is no candidate.
        rows += [(0, False, PLAIN, *m.span()) for m in WORD.finditer(text)]
    held = unite(taken + runs)
    for s, e in missed:
        left, value = outside(s, e, held), text[s:e]
        if not left or value.isdigit() and e - s >= 16:
            continue  # a base finding or run holds it, or it is among the long numbers
        mixed = bool(_DIGIT.search(value)) and any(c.isalpha() for c in value)
        rows.append((0 if left == [(s, e)] else None, mixed, kind_of(value), s, e))
    out = []
    for label, open_, kind, s, e in rows:
        codes, length = encode_window(text, s, e)
        out.append({"label": label, "open": open_, "kind": kind, "start": s, "end": e, "length": length, "codes": codes})
    return [{"kind": k, "start": s, "end": e} for s, k, e in base], out


def extract(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            found = [findings(t) for t in texts_of(batch)]
            return [batch.column(0), [f[0] for f in found], [f[1] for f in found]]

        return step

    return scan(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), make, ROWS)


def as_arrays(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """codes (bytes as they are), then the other columns."""
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, WIDTH)
    return codes, *(batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy()
                    for n in batch.schema.names if n != "codes")


SHARDS = "shard int, label int, length int, word boolean, held boolean, form int, codes binary"


def labelled_windows(rows: DataFrame) -> DataFrame:
    """The windows of all labelled findings, equal ones once; a hash keeps a quarter of them from training."""
    found = rows.select(F.explode("findings").alias("f")).select("f.*").where("label IS NOT NULL")
    n = F.greatest(F.ceil(F.col("length") / STEP), F.lit(1)).cast("int")
    at = f"least(k * {STEP}, greatest(length - {STEP}, 0))"
    found = found.withColumn("n", n).selectExpr("label", "length", "codes", f"kind = {PLAIN} word", "explode(sequence(0, n - 1)) k")
    found = found.selectExpr("label", f"least(length - {at}, {WIDTH - BEFORE}) length", "word", f"substring(codes, {at} + 1, {WIDTH}) codes").distinct()
    return found.selectExpr("label", "length", "word", "pmod(xxhash64(codes), 4) = 0 held", "codes")


def with_rewritten(windows: DataFrame, shards: int, per_label: int) -> DataFrame:
    """The windows in shards, each with windows made from its own.  A window's shard follows from its characters and the number of
    shards alone, however many tasks or partitions Spark makes of them, so training grows with the windows only."""
    arrow = to_arrow_schema(schema_of(SHARDS))

    def run(batches):
        for shard, (codes, label, length, word, held) in sorted(shards_of(batches).items()):
            mine = rewritten(codes, length, label, max(int((label == 1).sum()), int(REWRITTEN_SHARE * per_label)))
            more, more_length, more_label, form = mine
            n, k = len(label), len(more_label)
            columns = [np.full(n + k, shard), np.concatenate([label, more_label]), np.concatenate([length, more_length]),
                       np.concatenate([word, np.zeros(k, bool)]), np.concatenate([held, np.arange(k) % 4 == 0]),
                       np.concatenate([np.where(word | (label == 0), -1, len(FORMS)), form]), [c.tobytes() for c in [*codes, *more.astype(np.uint8)]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int32) if k in (0, 1, 2, 5) else c, type=f.type)
                                              for k, (c, f) in enumerate(zip(columns, arrow))], schema=arrow)

    dealt = windows.selectExpr(f"pmod(hash(codes), {shards}) shard", "label", "length", "word", "held", "codes")
    # Bounds come from a sample: with two ranges for a shard none holds two shards, as it may with one.
    spread = dealt.repartitionByRange(2 * shards, "shard").sortWithinPartitions("shard", "codes", "label", "length", "word")
    return spread.mapInArrow(run, schema_of(SHARDS))


def shards_of(batches) -> dict[int, tuple[np.ndarray, ...]]:
    """shard -> (codes, label, length, word, held, and form where it is known) of a task's rows."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return {}
    codes, shard, *rest = as_arrays(pa.Table.from_batches(batches))
    return {int(s): tuple(c[shard == s] for c in (codes, *rest)) for s in np.unique(shard)}


def train_round(shards: DataFrame, states: list[np.ndarray], turn: int) -> list[np.ndarray]:
    """The networks after a round: each shard trains them from the same state on its own rows, and the means of the results, by
    rows, are the next state.  A task adds up its shards'.  Network k does not see windows of form k; the last one sees all."""

    def run(batches):
        total, rows = [np.zeros_like(s) for s in states], [0] * len(states)
        for shard, (codes, label, length, word, held, form) in sorted(shards_of(batches).items()):
            rng = np.random.default_rng((8, shard, turn))
            words = np.flatnonzero(word & ~held)
            part = np.random.default_rng((8, shard)).permutation(len(words)) % ROUNDS == turn
            use = np.concatenate([np.flatnonzero(~word & ~held), words[part]])
            x, size, y, kind = codes[use].astype(np.int64), length[use], label[use] * 1.0, form[use]
            weight = np.where(word[use], ROUNDS * WORD_WEIGHT, 1.0)
            for k, state in enumerate(states):
                mine = rng.permutation(np.flatnonzero(kind != k) if k < len(FORMS) else len(use))
                weights = np.zeros(len(use))
                weights[mine] = balanced(y[mine], weight[mine])
                total[k] += len(mine) * CharCnn().load(state).epoch(x, size, y, weights, mine).state()
                rows[k] += len(mine)
        if any(rows):
            yield pa.RecordBatch.from_arrays([pa.array([k for k in range(len(rows))], pa.int32()), pa.array(rows, pa.int64()),
                                              pa.array([t.tobytes() for t in total], pa.binary())], names=["net", "n", "state"])

    sums, counts = [np.zeros_like(s) for s in states], [0] * len(states)
    for r in shards.mapInArrow(run, "net int, n bigint, state binary").collect():
        sums[r["net"]] += np.frombuffer(r["state"])
        counts[r["net"]] += r["n"]
    return [s / n if n else old for s, n, old in zip(sums, counts, states)]


def counted_logits(shards: DataFrame, states: list[np.ndarray]) -> dict[tuple[int, bool], tuple[np.ndarray, ...]]:
    """(network, unseen) -> (logits, labels, counts): of the rows kept from training that it would have seen, and of all of the
    form that it has not seen.  Logits are rounded down to 1 / ``BINS``, so that any number of rows gives few numbers."""

    def run(batches):
        for _, (codes, label, length, word, held, form) in sorted(shards_of(batches).items()):
            for k, state in enumerate(states):
                net = CharCnn().load(state)
                for unseen in (False, True):
                    use = np.flatnonzero(form == k if unseen else held & ((form != k) | (k == len(FORMS))))
                    if unseen and k == len(FORMS) or not len(use):
                        continue
                    at = np.concatenate([np.floor(net.logits(codes[p].astype(np.int64), length[p]) * BINS) for p in np.array_split(use, 1 + len(use) // 4096)])
                    keys, where = np.unique(np.stack([at.astype(np.int64), label[use]]), axis=1, return_inverse=True)
                    n = np.bincount(where.ravel(), np.where(word[use], WORD_WEIGHT, 1.0))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.int32()), pa.array([unseen] * len(n)), pa.array(keys[0]), pa.array(keys[1].astype(np.int32)), pa.array(n)],
                                                     names=["net", "unseen", "at", "label", "n"])

    found = shards.mapInArrow(run, "net int, unseen boolean, at bigint, label int, n double").groupBy("net", "unseen", "at", "label").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, bool], list] = {}
    for r in sorted(found.collect()):
        out.setdefault((r["net"], r["unseen"]), []).append((r["at"] / BINS, r["label"], r["n"]))
    return {k: tuple(np.array(c, np.float64) for c in zip(*v)) for k, v in out.items()}


def train(rows: DataFrame, per_label: int = TRAIN_ROWS, recall: float = RECALL, floor: float = FLOOR) -> CharCnn | None:
    """A calibrated network from all labelled findings of ``rows``, in shards of about ``per_label`` windows of each label; None if a
    label is missing.  The threshold is from networks that had not seen the form they score."""
    windows = materialize(labelled_windows(rows), "secret-windows")
    counts = {(r["label"], r["held"], r["word"]): r["count"] for r in windows.groupBy("label", "held", "word").count().collect()}
    if any(not sum(n for k, n in counts.items() if k[:2] == (label, held)) for label in (0, 1) for held in (False, True)):
        return None
    of_kind = [sum(n for k, n in counts.items() if (k[0], k[2]) == kind) for kind in ((1, False), (0, False), (0, True))]
    n_shards = max(-(-max(of_kind[:2]) // per_label), -(-of_kind[2] // WORD_ROWS))
    shards = materialize(with_rewritten(windows, n_shards, per_label), "secret-shards")
    states = [CharCnn().state() for _ in range(len(FORMS) + 1)]
    for turn in range(ROUNDS):
        states = train_round(shards, states, turn)
    found = counted_logits(shards, states)
    nets = [CharCnn().load(s).platt(*found[k, False]) for k, s in enumerate(states)]
    model = nets[-1]
    logit, label, n = found[len(FORMS), False]
    score, unseen = model.calibrated(logit), [(net.calibrated(found[k, True][0]), found[k, True][2]) for k, net in enumerate(nets) if (k, True) in found]
    hits, n_hits = (np.concatenate(c) for c in zip(*unseen)) if unseen else (score[label == 1], n[label == 1])
    return model.constrain(hits, score[label == 0], recall, floor, n_hits, n[label == 0])


def decoded(codes: bytes) -> str:
    """The characters of a window's classes (other letters as x)."""
    return "".join(chr(c + 31) if 1 <= c <= 95 else "x" if c == 96 else " " for c in bytes(codes))


def spelled(value: str, n: int, alphabet: str) -> str:
    """``n`` characters of an alphabet that follow from the value."""
    data = b"".join(hashlib.sha256(f"{k}{value}".encode()).digest() for k in range(1 + n // 32))
    return "".join(alphabet[b % len(alphabet)] for b in data[:n])


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def secret_form(form: str, value: str, words: list[str], draw: random.Random) -> str:
    if form == "value":
        return value
    if form == "short":
        return value[:draw.randint(16, max(16, min(24, len(value))))]
    if form == "upper":
        return spelled(value, draw.randint(16, 32), UPPER)
    if form == "base62":
        body = spelled(value, draw.randint(16, 44), draw.choice([BASE62, BASE62 + "+/", BASE62 + "-_"]))
        return base64.b64encode(body.encode()).decode().rstrip("=")[:draw.randint(20, 44)] if draw.random() < 0.3 else body
    # One head before hexadecimal or upper-case characters, or two before mixed ones.
    alphabet = draw.choice(["0123456789abcdef", UPPER]) if form == "marked" else BASE62
    heads = [w[:draw.randint(2, 5)].lower() for w in draw.choices(words, k=1 if form == "marked" else 2)]
    mark = draw.choice("_-")
    return mark.join([*heads, spelled(value, draw.randint(16, 40), alphabet)])


def plain_form(words: list[str], draw: random.Random) -> str:
    """An identifier, path, date, UUID or number of the words around."""
    kind = draw.randrange(6)
    number = str(draw.randrange(10 ** draw.randint(1, 4)))
    some = [w.lower() for w in draw.choices(words, k=draw.randint(2, 5))]
    if kind == 0:
        out = draw.choice("_-").join([*some, number])
    elif kind == 1:
        out = "".join(w.capitalize() for w in some) + number
    elif kind == 2:
        out = "/".join([*some, number]) if draw.random() < 0.5 else "/" + "/".join([number, *some])
    elif kind == 3:
        out = f"20{draw.randrange(30):02d}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}T{draw.randrange(24):02d}-{draw.randrange(60):02d}-{draw.randrange(60):02d}Z"
        out = out.replace("-", "") if draw.random() < 0.3 else out
    elif kind == 4:
        h = spelled(number + some[0], 32, "0123456789abcdef")
        out = "-".join([h[:8], h[8:12], h[12:16], h[16:20], h[20:]])
    else:
        out = "v" + number + draw.choice("-_") + draw.choice("-_").join(some) + draw.choice("-_=") + str(draw.randrange(100))
    return out


def rewritten(codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n: int = REWRITTEN, seed: int = 8):
    """(codes, lengths, labels, form) of windows made from these; form -1: no secret."""
    draw = random.Random(seed)
    texts = [decoded(c) for c in codes.astype(np.uint8)]
    values = []
    for text, size, label in zip(texts, lengths.tolist(), labels.tolist()):
        if label == 1:
            found = text[BEFORE:BEFORE + size]
            m = ASSIGN.search(found)
            value = m.group(2) if m else found
            if len(value) >= 16:
                values.append(value)
    keyword = re.compile("|".join(KEYWORDS), re.IGNORECASE)
    contexts = [(keyword.sub("text", t[:BEFORE]).replace("=", " ").replace(":", " "), t[BEFORE + int(k):]) for t, k in zip(texts, lengths)]
    words = sorted({w for before, after in contexts for w in re.findall("[A-Za-z]{3,}", before + " " + after)}) or ["text"]
    rows = []
    draw.shuffle(values)
    for k in range(n if values else 0):  # every value, and again up to n
        rows.append((1.0, k % len(FORMS), secret_form(FORMS[k % len(FORMS)], values[k % len(values)], words, draw)))
    rows += [(0.0, -1, form) for _ in range(n) if len(form := plain_form(words, draw)) >= 16]
    out = []
    for label, form, run in rows:
        before, after = draw.choice(contexts)
        before = before.rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-") or " "
        text = (before if before[-1:] in " \"'" else before + " ") + run + draw.choice([" ", ". ", "\n", '" ', ", "]) + after.lstrip()
        window, size = encode_window(text, text.index(run, len(before) - 1 if before else 0), text.index(run, len(before) - 1 if before else 0) + len(run))
        out.append((np.frombuffer(window[:WIDTH], np.uint8).astype(np.int64), min(size, WIDTH - BEFORE), label, form))
    return tuple(np.array(c) for c in zip(*out))


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def added_spans(found: list[dict], model: CharCnn | None) -> list[tuple[int, int, int]]:
    open_ = [f for f in found if f["open"]]
    if not open_ or model is None:
        return []
    scores = model.score_runs([(f["codes"], f["length"]) for f in open_])
    return [(f["start"], f["kind"], f["end"]) for f, s in zip(open_, scores) if s >= model.threshold]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document the base findings and all spans."""
    rows = materialize(extract(docs), "secret-findings")
    model = train(rows)

    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for base, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine = [(b["start"], b["kind"], b["end"]) for b in base]
                more = added_spans(found, model)
                n = [sum(k == kind for _, k, _ in mine) for kind in range(3)]
                out.append((*n, hashlib.sha256(join_spans(mine).encode()).hexdigest(), join_spans(mine + more), len(more)))
            return [batch.column(0), *([r[k] for r in out] for k in range(6))]

        return step

    return scan(rows, make, OUT)


def redact(docs: DataFrame, mark: str = "[{}]") -> DataFrame:
    """``docs`` (all columns) with every span of the text replaced by its kind; n_chars follows the text."""
    model = train(materialize(extract(docs), "secret-findings"))
    names = docs.columns

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out = []
            for text in texts:
                base, found = findings(text or "")
                spans = sorted([(b["start"], b["end"], b["kind"]) for b in base] + [(s, e, k) for s, k, e in added_spans(found, model)])
                out.append(replace_spans(text, spans, mark) if spans else text)
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(out, columns[names.index("text")].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                changed = [n if a is b else len(b) for n, a, b in zip(columns[at].to_pylist(), texts, out)]
                columns[at] = pa.array(changed, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def replace_spans(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """Overlapping spans are replaced together, under the first one's kind."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], mark.format(KINDS[kind])]
        at = max(at, end)
    return "".join(parts) + text[at:]
