import gzip
import hashlib

from pyarrow import fs

from featurestats.llm import warc

PAGES = "page_id bigint, url string, html string, payload_digest string, revisit string, file string"


def brute(rows):
    payload = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payload:
        first = min((j is None, j) for j, q in payload if q == p)[1] if len(p) >= 100 and any(j is not None for j, q in payload if q == p) else None
        alone = len(p) < 100 or i == first
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if alone else "revisit", None if alone else first))
    return sorted(out, key=repr)


def test_pages(spark):
    big = "<html>" + "é" * 60 + "</html>\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, big), (1, "http://b", big), (None, "http://n", big), (4, "", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "u", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], PAGES)
    assert sorted((tuple(r) for r in warc.archive(df).collect()), key=repr) == brute(rows)
    assert warc.archive(df.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted((tuple(r) for r in warc.archive(real).collect()), key=repr) == brute([tuple(r) for r in real.select("page_id", "url", "html").collect()])


def test_archives_are_plain_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "p" * 200), (2, "http://b", "p" * 200)], "page_id bigint, url string, html string")
    index = warc.write_archives(pages, f"file://{tmp_path}/out", date="2024-01-01T00:00:00Z").collect()
    assert {(r["page_id"], r["record_type"]) for r in index} == {(1, "response"), (2, "revisit")}
    for r in index:
        with open(f"{tmp_path}/out/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            fields, block = warc.parse(gzip.decompress(f.read(r["length"])))
        assert fields["WARC-Type"] == r["record_type"] and fields["WARC-Record-ID"] == r["record_id"]
        if r["record_type"] == "revisit":
            assert fields["WARC-Refers-To"] == warc.record_id(1, hashlib.sha256(b"p" * 200).hexdigest()) and b"ppp" not in block
    # A file that no index row names, as a lost task leaves it, is not read.
    store, root = fs.FileSystem.from_uri(f"file://{tmp_path}/out")
    with store.open_output_stream(f"{root}/part-lost.warc.gz", compression=None) as sink:
        sink.write(b"broken")
    assert warc.read_archives(spark, f"file://{tmp_path}/out", spark.createDataFrame(index)).count() == 2
