import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from featurestats.llm import token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(df):
    library, start, out = Tokenizer.from_file(PATH), 0, []
    rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_in_order(docs, edge_docs, no_docs):
    for df in (docs, edge_docs):
        got = sorted((tuple(r) for r in token_files.encode_to_files(df, PATH).collect()), key=lambda r: r[1])
        assert got == brute(df)
    assert token_files.encode_to_files(no_docs, PATH).count() == 0


def test_file_format(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, PATH, n_files=2)
    for name in glob.glob(path + "/*.parquet"):
        group = pq.ParquetFile(name).metadata.row_group(0)
        ids = next(group.column(i) for i in range(group.num_columns) if group.column(i).path_in_schema.startswith("ids"))
        assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_offset_index and ids.has_column_index
    plan = spark.read.parquet(path).where("doc_id = 5").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1] and "EqualTo(doc_id,5)" in plan


def test_selective_reads(spark, docs, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path, PATH, n_files=4)
    ids = {r["doc_id"]: r["ids"] for r in token_files.read_range(spark, path, 20, 40).collect()}
    library = Tokenizer.from_file(PATH)
    assert ids == {r["doc_id"]: [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
                   for r in docs.where("doc_id >= 20 AND doc_id < 40").collect()}
    part = token_files.read_range(spark, path, 20, 40)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20)" in part and "LessThan(doc_id,40)" in part
    known = token_files.read_metadata(spark, path)
    assert "ids" not in known._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert known.count() == docs.count()


def test_one_coder_for_each_worker():
    assert token_files.worker_coder(PATH, 0) is token_files.worker_coder(PATH, 0)


def test_words_in_two_generations():
    """A cache of few words gives the same ids as the library: words go and come back."""
    library, coder = Tokenizer.from_file(PATH), token_files.LibraryCoder(PATH, 0, cache_words=5)
    texts = ["one two three, four five.", "six seven eight\nnine ten", "one six two. seven", "", "a  b", "one two three, four five."]
    for _ in range(3):
        for t in texts:
            want = [*library.encode(t, add_special_tokens=False).ids, 0]
            ids, sizes = coder.encode(pa.array([t]))
            assert ids.tolist() == want and sizes.tolist() == [len(want)]
    ids, sizes = coder.encode(pa.array([*texts, None]))
    assert ids.tolist() == [x for t in [*texts, ""] for x in [*library.encode(t, add_special_tokens=False).ids, 0]]
