import hashlib
import itertools
import re
import time

from pyspark.sql import functions as F

from lamina.llm import pii
from lamina.llm.pii import find_pii, redact

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def brute(text):
    spans = {k: [m.span() for m in re.finditer(p, text or "") if valid(k, m[0])] for k, p in BASE.items()}
    line = ",".join(f"{k}:{a}:{b}" for k in BASE for a, b in spans[k])
    return tuple(len(spans[k]) for k in BASE) + (hashlib.sha256(line.encode()).hexdigest(),)


ODD = [
    None, "", "a@b.c_d@e.f", "a@b@c.d.", "x+y@z-.q.9 %@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1 1.2.3.00000000000000000255",
    "4111 1111 1111 1111", "4111-1111-1111-1111 9", "😀 4111111111111111 é 4111111111111112", "+1 (017) 555-7713 +12 +1234567 8", "+1((((((((((2345678",
    "5" * 5000, "a." * 4000, "1." * 4000, "+1" + "." * 4000, "a@" * 3000, "4 " * 4000, "text\n4111111111111111\r\n1.1.1.1",
]


def test_base_spans_match_brute_force(spark, make, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(make([(10_000 + i, t) for i, t in enumerate(ODD)]))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = find_pii(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == brute(texts[r.doc_id]), texts[r.doc_id][:80]


def test_added_kinds_need_a_checksum_or_context(make):
    rows = [
        (0, "pay to GB82 WEST 1234 5698 7654 32 now"), (1, "pay to GB83 WEST 1234 5698 7654 32 now"),
        (2, "my ssn 123-45-6789"), (3, "part 123-45-6789"), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e"'), (5, "04dbebab91ab85687d33eeaaf9ac699e"),
    ]
    got = {r.doc_id: r for r in find_pii(make(rows)).collect()}
    assert [got[i].spans for i in range(6)] == ["iban:7:34", "", "ssn:7:18", "", "secret:9:41", ""]
    assert got[2].scores == "60"


def test_context_moves_the_score_and_rows_stay(make):
    rows = [(1, "card 4111111111111111"), (1, "xxxx 4111111111111111"), (None, "a@b.cc"), (1, "card 4111111111111111")]
    got = find_pii(make([(*r, "x") for r in rows], "doc_id long, text string, spans string")).collect()
    assert sorted(r.scores for r in got) == ["65", "70", "95", "95"]
    assert find_pii(make([])).count() == 0


def test_redact(make):
    rows = [(1, "é a@b.cc and +1 (017) 555-7713!"), (2, None), (3, "clean")]
    assert {r.doc_id: r.text for r in redact(make(rows)).collect()} == {1: "é [EMAIL] and [PHONE]!", 2: None, 3: "clean"}


def test_running_folds(spark):
    for n in (0, 1, 31, 32, 33, 1024, 1025, 33_000):
        values = [i * 7 % 11 for i in range(n)]
        got = spark.createDataFrame([(values,)], "a array<int>").select(pii._running(F.col("a"), F.lit(5), lambda x, y: x + y)).first()[0]
        assert got == list(itertools.accumulate([5, *values[:-1]]))[:n]


def test_very_many_spans_cost_linear_time(make):
    """100,000 spans in a text: a quadratic fold would take some ten minutes."""
    text = "ab@c.de " * 100_000
    began = time.perf_counter()
    row = find_pii(make([(1, text)])).first()
    assert row.n_email == 100_000 and row.spans.endswith("email:799992:799999") and (row.n_email, row.n_ip, row.n_card, row.n_phone, row.base_sha256) == brute(text)
    assert redact(make([(1, text)])).first().text == "[EMAIL] " * 100_000
    assert time.perf_counter() - began < 120


def test_redact_matches_brute_force(spark, make, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(make([(10_000 + i, t) for i, t in enumerate(ODD)]))
    spans = {r.doc_id: r.spans for r in find_pii(docs).collect()}
    before = dict(docs.collect())
    for doc_id, text in redact(docs).collect():
        if before[doc_id] is None:
            assert text is None
            continue
        out, at = [], 0
        for a, b, k in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans[doc_id].split(",") if x)):
            if a >= at:
                out += [before[doc_id][at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert text == "".join(out) + before[doc_id][at:]
