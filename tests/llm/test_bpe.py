import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from featurestats.llm import bpe
from featurestats.llm.units import irregular, split_units, unit_text

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", ".", ",", "a", "B", "é", "'s", "'", "!", "$", "1", "½", "\t", "\x1c", "\xa0", "日", "م", "🙂", "<|endoftext|>", "²", "the", "abababab"]


def expected(library, doc_id, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_equals_the_library(docs, edge_docs, no_docs):
    library = Tokenizer.from_file(PATH)
    for df in (docs, edge_docs):
        want = sorted((expected(library, r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=repr)
        assert sorted((tuple(r) for r in bpe.encode_documents(df, PATH).collect()), key=repr) == want
    assert bpe.encode_documents(no_docs, PATH).count() == 0


def test_random_texts():
    library, coder, draw = Tokenizer.from_file(PATH), bpe.Coder(PATH, cache_words=50), random.Random(1)
    texts = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    for text, ids in zip(texts, coder.encode(pa.array(texts))):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert coder.decode(ids) == text


def test_forced_cuts():
    vocab = bpe.Vocabulary(PATH)
    assert not vocab.inside[ord("a"), ord(" ")] and vocab.inside[ord(" "), ord("t")]
    # However a fragment is merged, by rounds or with the heap, the ids are the same.
    for piece in (b"abcabc" * 30, b"\xc3\xa9" * 90, b"=" * 200):
        rounds = list(vocab._merge_all(vocab.id_of_byte[np.frombuffer(piece, np.uint8)], np.zeros(len(piece), np.int64)))
        assert vocab._merge_long(vocab.id_of_byte[np.frombuffer(piece, np.uint8)].tolist()) == np.concatenate([r[0] for r in rounds]).tolist()


def test_units_join_to_the_text():
    for text in ("a b.c, d\nE f", "x", "a\nb", "é. ﬁ x\n"):
        assert not irregular(pa.array([text]))[0]
        assert "".join(map(unit_text, split_units(pa.array([text]))[0].as_py())) == text
    odd = ["", " a", "a  b", "a ", "a\n\nb", "a..b", "a!.", "\u0416.", "a\t b", "x\xa0\ny", ".a", "a\x01b", "a <|e|> b"]
    assert irregular(pa.array(odd), "<|e|>").all()


def test_tokens_round_trip(edge_docs):
    rows = bpe.tokenize_documents(edge_docs, PATH).collect()
    assert len(rows) == edge_docs.count() and all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)
