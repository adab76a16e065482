import hashlib
import random
import re

from featurestats.llm import personal

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(int(d) if k % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for k, d in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def test_base_matches():
    draw = random.Random(3)
    parts = ["@", ".", "a", "b-", "1", "25", "256", "4111111111111111", "+", "-", " ", "(", ")", "%", "é", "0", "999", ".1.2.3", "@x.y", "+1 (555) 123-4567"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 12)))
        assert personal.join_spans([(s, k, e) for k, s, e, holds in personal.base_matches(text) if holds]) == brute(text), text
    assert personal.base_matches("9" * 100_000 + "." * 3)[0][3] is False  # long runs stay linear


def test_base_stays_and_more_is_added(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame([(5000, "call me +1 (269) 555-3296 4524132264652876 and so on"), (5001, "phone (269) 555-3296 today"), (5002, "order 269-555-32 1.2.3")], "doc_id bigint, text string"))
    rows = {r["doc_id"]: r for r in personal.find_personal(docs).collect()}
    for r in docs.collect():
        want = brute(r["text"])
        got = rows[r["doc_id"]]
        assert got["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got["spans"].split(","))
        assert got["n_email"] + got["n_ip"] + got["n_card"] + got["n_phone"] + got["n_added"] == len([s for s in got["spans"].split(",") if s])
    assert "phone:8:25" in rows[5000]["spans"] and "phone:6:20" in rows[5001]["spans"] and rows[5002]["spans"] == ""
    assert personal.find_personal(edge_docs).count() == edge_docs.count()
    assert personal.find_personal(no_docs).count() == 0
    assert personal.find_personal(edge_docs.where("doc_id = 1")).first()["spans"] == ""


def test_em_finds_the_bad_labeler():
    draw = random.Random(1)
    counts = {}
    for _ in range(3000):
        truth = draw.random() < 0.6
        votes = [(1 if truth else -1) * (1 if draw.random() < right else -1) for right in (0.95, 0.9, 0.9, 0.85, 0.5)]
        key = (2, personal.pack_votes(votes))
        counts[key] = counts.get(key, 0) + 1
    found = personal.estimate(counts)
    right = [found.table[2, 1, k, 1] for k in range(5)]
    assert abs(found.prior[2] - 0.6) < 0.05 and abs(right[0] - 0.95) < 0.03 and abs(right[4] - 0.5) < 0.06


def planted(draw):
    host = lambda: draw.choice(["example", "mailbox", "uni-koeln"]) + "." + draw.choice(["com", "org", "de"])
    name, four = (lambda: draw.choice(["anna", "jorge", "li.wei", "k_meier"])), (lambda: f"{draw.randrange(4096, 65536):x}")
    return {
        "bracketed": lambda: f"{name()} [at] {host()}", "dotted": lambda: f"{name()}(at){host().replace('.', ' (dot) ')}", "spelled": lambda: f"{name()} at {host().replace('.', ' dot ')}",
        "ipv6": lambda: ":".join(four() for _ in range(8)), "short ipv6": lambda: f"{four()}:{four()}::{four()}",
        "brackets": lambda: f"({draw.randrange(200, 999)}) {draw.randrange(200, 999)}-{draw.randrange(1000, 9999)}", "dashes": lambda: f"{draw.randrange(200, 999)}-555-{draw.randrange(1000, 9999)}",
        "national": lambda: f"0{draw.randrange(30, 999)} {draw.randrange(1000000, 99999999)}", "pairs": lambda: f"0{draw.randrange(1, 8)}" + "".join(f" {draw.randrange(100):02d}" for _ in range(4)),
        "-version": lambda: f"version {draw.randrange(9)}.{draw.randrange(9)}.{draw.randrange(99)}", "-order": lambda: f"order {draw.randrange(10**5)}-{draw.randrange(999)}",
        "-time": lambda: f"{draw.randrange(24):02d}:{draw.randrange(60):02d}:{draw.randrange(60):02d}", "-date": lambda: f"2024-0{draw.randrange(1, 9)}-1{draw.randrange(9)}",
        "-meet": lambda: f"{name()} at {draw.choice(['home', 'noon'])} and so on", "-std": lambda: "std::vector of dot at",
    }


def test_forms_that_no_base_pattern_matches(spark):
    draw, rows = random.Random(4), []
    some = "thaner stioner andhe ertion hathe onstion edre inghan".split()
    for form, make in planted(draw).items():
        for _ in range(50):
            before, value = " ".join(draw.choices(some, k=9)) + " ", make()
            rows.append((form, before + value + " " + " ".join(draw.choices(some, k=6)), len(before), len(before) + len(value)))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = personal.find_personal(docs.unionByName(spark.createDataFrame([(10_000 + k, r[1]) for k, r in enumerate(rows)], "doc_id bigint, text string")))
    got = {r["doc_id"]: r for r in found.collect()}
    hits, n = {}, {}
    for k, (form, text, a, b) in enumerate(rows):
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[10_000 + k]["spans"].split(",") if s]
        n[form], hits[form] = n.get(form, 0) + 1, hits.get(form, 0) + any(s < b and a < e for s, e in spans)
        assert got[10_000 + k]["n_spans"] == len(spans)
    assert all(hits[f] >= 0.9 * n[f] for f in n if f[0] != "-"), hits
    assert not any(hits[f] for f in n if f[0] == "-"), hits
    assert sum(r["n_added"] for i, r in got.items() if i < 10_000) <= 0.01 * docs.count()
