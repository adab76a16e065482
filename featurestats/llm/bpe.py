"""Operator 6: BPE encoding and decoding by forced-boundary splitting.

A BPE merge only ever makes vocabulary tokens.  A pair of bytes that stands side by side inside no token can
therefore never be merged over: it is a certain cut.  ``Vocabulary.inside`` is the 256 x 256 table of pairs that do occur.
A text is cut where the pre-tokenizer cuts; each piece is cut again at every pair missing from the table; the fragments
are merged independently (lowest rank first, leftmost on ties) and their ids concatenated.  Fragments and words repeat,
so words are cached, with a bound.  The word cache cuts before blanks, line feeds, full stops and commas, where the
pre-tokenizer surely cuts (``units``).

Results: a null or empty text has no ids and decodes to ''.  The special token's string in a text becomes its one id.
Rows pass one to one (repeated rows and null ids stay); extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import scan, texts_of
from .units import LAST_SURE_LETTER, MARKS, UnitCache, chunks_of

OUT = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
TOKENS = "doc_id bigint, lang string, source string, n_chars bigint, n_tokens bigint, ids array<int>, round_trip boolean"


#: Documents whose texts and ids are held at a time.
ROWS = 1000
#: Fragments beyond this many bytes are merged one by one with a heap.
LONG = 96
SURE_LETTER = chr(LAST_SURE_LETTER)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the rest follows from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
        ordinary = [self.bytes_of[i] for i in model["vocab"].values()]
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.byte_id = {b[0]: i for i, b in enumerate(self.bytes_of) if len(b) == 1}
        vocab = model["vocab"]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        self.none = len(pairs)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], -1), np.append(np.array([*self.rank.values()])[order], self.none)
        self.id_of_byte = np.zeros(256, np.int64)
        for i, b in enumerate(self.bytes_of):
            if len(b) == 1:
                self.id_of_byte[b[0]] = i
        self.inside = np.zeros((256, 256), bool)
        for b in ordinary:
            a = np.frombuffer(b, np.uint8)
            self.inside[a[:-1], a[1:]] = True
        #: The word cache needs the usual byte-level pre-tokenizer: it cuts only where that one does.
        pre = spec["pre_tokenizer"] or {}
        self.by_words = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.pair_keys[:-1], keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.none)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, number of ids of each piece, number of fragments) of pre-tokenizer pieces, all at once.

        Each piece is cut at its forced pairs; each round makes the lowest-ranked merge, leftmost on ties, in every
        fragment that still has one."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(len(pieces), np.int64), 0
        sizes = np.array([len(p) for p in pieces], np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        cut = np.ones(len(flat), bool)
        cut[1:] = (piece[1:] != piece[:-1]) | ~self.inside[flat[:-1], flat[1:]]
        fragment = np.cumsum(cut) - 1
        n_fragments = int(fragment[-1]) + 1
        lengths = np.bincount(fragment)
        ids, done = self.id_of_byte[flat], []
        long = np.flatnonzero(lengths > LONG)
        if len(long):
            bounds = np.append(np.flatnonzero(cut), len(flat))
            for f in long:
                merged = self._merge_long(ids[bounds[f]:bounds[f + 1]].tolist())
                done.append((np.array(merged, np.int64), np.full(len(merged), f)))
            short = lengths[fragment] <= LONG
            ids, where = ids[short], fragment[short]
        else:
            where = fragment
        done.extend(self._merge_all(ids, where))
        ids, where = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(where, kind="stable")
        owner = piece[np.flatnonzero(cut)][where]
        return ids[order], np.bincount(owner, minlength=len(pieces)), n_fragments

    def _merge_all(self, ids: np.ndarray, where: np.ndarray):
        """Merge within runs of equal ``where``; yields (ids, where) of runs as they end."""
        if not len(ids):
            return
        none = self.none
        ranks = np.full(len(ids), none)
        inner = where[:-1] == where[1:]
        ranks[:-1][inner] = self.ranks_of(ids[:-1][inner], ids[1:][inner])
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            low = np.minimum.reduceat(ranks, first)
            over = low == none
            if over.any():
                out = np.repeat(over, size)
                yield ids[out], where[out]
                ids, where, ranks = ids[~out], where[~out], ranks[~out]
                if not len(ids):
                    return
                size, low = size[~over], low[~over]
            hits = np.flatnonzero(ranks == np.repeat(low, size))
            owner = where[hits]
            at = hits[np.concatenate([[True], owner[1:] != owner[:-1]])]
            ids[at] = self.made[low]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, where, ranks = ids[keep], where[keep], ranks[keep]
            ranks[at] = none
            both = at[(at + 1 < len(ids)) & (where[np.minimum(at + 1, len(ids) - 1)] == where[at])]
            ranks[both] = self.ranks_of(ids[both], ids[both + 1])
            prior = at[(at > 0) & (where[at - 1] == where[at])] - 1
            ranks[prior] = self.ranks_of(ids[prior], ids[prior + 1])

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list: n log n for long fragments."""
        n, rank_of, made = len(ids), self.rank.get, self.made.tolist()
        following, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = following[i] if alive[i] else -1
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j] = made[r], False
            following[i] = k = following[j]
            if k >= 0:
                before[k] = i
            h = before[i]
            for a, b in ((i, k), (h, i)):
                if a >= 0 and b >= 0 and (r := rank_of((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x, live in zip(ids, alive) if live]


class Coder:
    """Encoder and decoder with a bounded cache; ids travel as little-endian uint32 bytes."""

    def __init__(self, path: str, cache_words: int = 120_000):
        from tokenizers import Tokenizer

        self.vocab = Vocabulary(path)
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.alphabet = byte_alphabet()
        self.special = next(iter(self.vocab.special), None)
        self.words = UnitCache(self.encode_units, self.encode_whole, cache_words, self.special)
        self.table = np.array(self.vocab.bytes_of, dtype=object)
        self.n_fragments = 0

    def pieces(self, text: str) -> list[bytes]:
        """What the vocabulary's own pre-tokenizer makes of ``text``."""
        if text in MARKS:
            return [text.encode()]
        word, lead = (text[1:], [b"\n"]) if text[0] == "\n" else (text, [])
        plain = word[1:] if word[0] == " " else word
        if self.vocab.by_words and plain.isalpha() and (plain.isascii() or max(plain) <= SURE_LETTER):
            return [*lead, word.encode()]
        alphabet = self.alphabet
        return [bytes([alphabet[c] for c in piece]) for piece, _ in self.pre.pre_tokenize_str(text)]

    def encode_units(self, units: list[str]) -> list[bytes]:
        pieces = [self.pieces(u) for u in units]
        ids, counts, n = self.vocab.encode_pieces([p for ps in pieces for p in ps])
        self.n_fragments += n
        flat, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(counts)
        last = np.cumsum([len(ps) for ps in pieces]) - 1
        out, start = [], 0
        for end in ends[last].tolist() if len(ends) else []:
            out.append(flat[start:end])
            start = end
        return out

    def encode_whole(self, text: str) -> bytes:
        if self.special is None or self.special not in text:
            return self.encode_units([text])[0] if text else b""
        end = np.array([self.vocab.special[self.special]], "<u4").tobytes()
        return end.join(self.encode_units([part])[0] if part else b"" for part in text.split(self.special))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (nulls as '')."""
        for chunk in chunks_of(texts, 4 << 20):
            if not self.vocab.by_words:
                yield from map(self.encode_whole, chunk.to_pylist())
                continue
            ids, counts = self.words(chunk)
            ends = np.cumsum(counts)
            for a, b in zip((ends - counts).tolist(), ends.tolist()):
                yield ids[a:b].tobytes()

    def decode(self, ids: bytes) -> str:
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def worker_coder(path: str) -> Coder:
    """One coder in each Python worker: tasks that follow find its words."""
    return Coder(path)


def encode_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: the number of ids, the SHA-256 of the ids and of the text decoded from them."""

    def make():
        coder = worker_coder(vocab_path)

        def step(batch: pa.RecordBatch):
            n, ids_sha, text_sha = [], [], []
            for ids in coder.encode(batch.column(1)):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            return [batch.column("doc_id"), n, ids_sha, text_sha]

        return step

    return scan(docs.selectExpr("CAST(doc_id AS BIGINT) doc_id", "text"), make, OUT, ROWS)


def tokenize_documents(docs: DataFrame, vocab_path: str) -> DataFrame:
    """Per document its ids, as training reads them; ``round_trip``: decoding them gave the text again."""

    def make():
        coder = worker_coder(vocab_path)

        def step(batch: pa.RecordBatch):
            ids, sizes, same = [], [], []
            for text, x in zip(texts_of(batch), coder.encode(batch.column(4))):
                ids.append(x)
                sizes.append(len(x) // 4)
                same.append(coder.decode(x) == text)
            ends = np.cumsum([0, *sizes]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            return [*batch.columns[:4], sizes, pa.ListArray.from_arrays(pa.array(ends), flat), same]

        return step

    columns = ["CAST(doc_id AS BIGINT) doc_id", "lang", "source", "CAST(n_chars AS BIGINT) n_chars", "text"]
    return scan(docs.selectExpr(*columns), make, TOKENS, ROWS)
