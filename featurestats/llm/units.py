"""Cutting text at places no byte-level BPE token can cross, for word-wise caching.

The pre-tokenizer of the byte-level vocabularies matches runs of letters, of digits and of other signs
(each with one leading blank), contractions, and white space.  Its matches look back at nothing, so a text may be cut

* before a blank or line feed that follows anything but white space, and
* before a full stop or comma that follows a letter or digit,

and the pieces encoded alone give the tokens of the whole.  ``irregular`` finds the texts where some blank or mark stands
elsewhere; those are encoded whole.  The others are cut, and their distinct words found, by Arrow's own functions; Python
sees each distinct word of a chunk once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARKS = ("\n", ".", ",")
LAST_SURE_LETTER = 0x24F  # beyond it, Unicode versions may differ on what a letter is
#: Stands before the first word of a text, which has no blank before it.
FIRST = "\x01"


def _class(code_points) -> str:
    return "".join(f"\\x{{{c:x}}}" for c in code_points)


#: Letters and digits after which a full stop or comma may be cut off; white space after which nothing may.
SURE = _class(c for c in range(LAST_SURE_LETTER + 1) if chr(c).isalpha() or chr(c) in "0123456789")
WHITE = _class(c for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n")
IRREGULAR = rf"\A[ \n.,]| \z|[ \n][ \n]|[^{SURE}][.,]|[{WHITE}][ \n]|{FIRST}"


def irregular(texts: pa.Array, special: str | None = None) -> np.ndarray:
    """Which texts can't be cut surely everywhere (empty ones included)."""
    found = pc.match_substring_regex(texts, IRREGULAR)
    if special:
        found = pc.or_(found, pc.match_substring(texts, special))
    return pc.or_(found, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)


def split_units(texts: pa.Array) -> pa.ListArray:
    """The words of regular texts, cut before blanks (which go), line feeds, full stops and commas."""
    out = pc.binary_join_element_wise(FIRST, texts, "")
    for mark in MARKS:
        out = pc.replace_substring(out, mark, " " + mark)
    return pc.split_pattern(out, " ")


def unit_text(word: str) -> str:
    if word[0] == FIRST:
        return word[1:]
    return word if word[0] in MARKS else " " + word


class UnitCache:
    """word -> encoded bytes, in two generations: when the young one holds over ``limit`` words it becomes the old
    one, from which words still in use are taken back.  It grows by the words of one chunk beyond that at most.

    ``encode_units(list of unit texts) -> list of bytes`` fills it; ``encode_whole(text) -> bytes`` takes the
    texts that can't be cut surely.  Ids are little-endian 32-bit integers."""

    def __init__(self, encode_units, encode_whole, limit: int = 300_000, special: str | None = None):
        self.encode_units, self.encode_whole, self.limit, self.special = encode_units, encode_whole, limit, special
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of a bounded chunk of texts without nulls."""
        odd = irregular(texts, self.special)
        if not odd.any():
            return self._regular(texts)
        flat, sizes = self._regular(texts.filter(pa.array(~odd)))
        counts = np.zeros(len(texts), np.int64)
        counts[~odd] = sizes
        whole = [np.frombuffer(self.encode_whole(t), "<u4") if t else np.zeros(0, "<u4") for t in texts.filter(pa.array(odd)).to_pylist()]
        counts[odd] = [len(x) for x in whole]
        ends = np.cumsum(counts)
        out = np.zeros(int(counts.sum()), "<u4")
        out[np.repeat((ends - counts)[~odd] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))] = flat
        for end, ids in zip(ends[odd].tolist(), whole):
            out[end - len(ids):end] = ids
        return out, counts

    def _regular(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lists = split_units(texts)
        coded, of_text = lists.values.dictionary_encode(), lists.offsets.to_numpy()
        del lists
        found = self._look_up(coded.dictionary.to_pylist())
        # 32 bits do: a chunk is bounded, and so is a text.
        size = (np.fromiter(map(len, found), np.int32, len(found)) // 4).astype(np.int32)
        start = np.cumsum(size, dtype=np.int32) - size
        word = coded.indices.to_numpy()
        each = size[word]
        ends = np.zeros(len(word) + 1, np.int32)
        np.cumsum(each, out=ends[1:])
        at = np.repeat(start[word] - ends[:-1], each)
        at += np.arange(len(at), dtype=np.int32)
        return np.frombuffer(b"".join(found), "<u4")[at], np.diff(ends[of_text]).astype(np.int64)

    def _look_up(self, words: list[str]) -> list[bytes]:
        if len(self.known) > self.limit:
            self.old, self.known = self.known, {}
        found = list(map(self.known.get, words))
        gaps = [i for i, ids in enumerate(found) if ids is None]
        if gaps:
            missing, old = [words[i] for i in gaps], self.old
            self.known.update((w, old[w]) for w in missing if w in old)
            new = [w for w in missing if w not in old]
            if new:
                self.known.update(zip(new, self.encode_units([unit_text(w) for w in new])))
            for i in gaps:
                found[i] = self.known[words[i]]
        return found


def chunks_of(texts: pa.Array, limit: int = 6 << 20):
    """Pieces of an array of texts (nulls as '') of about ``limit`` bytes; a longer text is taken alone."""
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop
