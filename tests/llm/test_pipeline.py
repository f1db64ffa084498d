"""The pipeline stage by stage against plain Python over the same rows."""

import collections
import re

from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import decontaminate, langid

from .test_jaccard_join import brute
from .test_pii import BASE, valid
from .test_text_operators import brute_language as langid_brute

#: Columns of documents, and others whose names the operators use inside.
CLASHING = ["k", "n", "size", "_id", "target", "root", "score", "lang_pred", "pii_email", "stays"]


def odd_documents(spark, sf):
    """The table with extra columns, and rows of null, empty, very long and repeated texts and of a null id."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    some = [r for r in docs.orderBy("doc_id").limit(60).collect() if r.lang and len(r.text.split()) > 60]
    long = " ".join(r.text for r in some[:20]) * 30
    odd = [(90_001, None, None, None, None), (90_002, "", "en", "src", 0), (90_003, "12 34 %$ \n", None, "src", 10), (90_004, long, None, None, len(long))]
    odd += [(some[7].doc_id, some[7].text, some[7].lang, some[7].source, len(some[7].text))] * 2  # with the table's own row there are three
    odd += [(None, " ".join(reversed(some[9].text.split())), "x", "src", None), (90_005, some[11].text, None, "zz", len(some[11].text))]
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionAll(spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema))
    return both.withColumns({c: F.lit(f"own {c}") for c in CLASHING}), some


def test_stages(spark, sf, tmp_path):
    odd, some = odd_documents(spark, sf)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = corpus_pipeline.table(spark, sf, "documents")
    COLUMNS = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "private_data", "source_mix"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    assert all(df.columns == COLUMNS for df in seen[:-1])
    assert all(r[c] == f"own {c}" for r in rows[4].values() for c in CLASHING)
    ids = [collections.Counter(r.doc_id for r in df.select("doc_id").collect()) for df in seen]
    assert {90_001, 90_002, 90_003, 90_004, 90_005, None} <= set(rows[0]) and ids[0][some[7].doc_id] == ids[1][some[7].doc_id] == 3
    assert not {90_001, 90_002, 90_003} & set(rows[1]) and {90_004, None} <= set(rows[2]) and 90_005 not in rows[2]
    assert all(set(c.values()) == {1} for c in ids[2:])  # of repeated rows one stays
    # documents that fit a learned language stay, with all their rows
    known = langid.profiles(docs)
    scored = {i: langid_brute(r.text, known) for i, r in rows[0].items()}
    assert set(rows[1]) == {i for i, r in scored.items() if r != "und" and r[1] >= langid.MIN_SCORE}
    assert len(rows[1]) >= len(rows[0]) - 3
    # of each group the least id stays
    groups = brute([(10**9 if i is None else i, r.text) for i, r in rows[1].items()])
    assert {10**9 if i is None else i for i in rows[2]} == {d for d, n, c in groups if d == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower())
    exact = {i for i, r in rows[2].items() if any(f" {clean(t).strip()} " in f" {clean(r.text)} " for _, t in bench)}
    assert exact and exact <= set(rows[2]) - set(rows[3])
    index = decontaminate.build(bench)
    words = lambda t: decontaminate.words_of(decontaminate.pa.array([t])).hash
    for i, r in rows[2].items():
        near = any(decontaminate.search(item, words(r.text))[0] <= int(decontaminate.edits(len(item))) for item in index.words) if r.text.strip() else False
        assert near or i in rows[3]
    # nothing private is left, and other texts are as they were
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        assert not any(valid(k, m[0]) for k, p in BASE.items() for m in re.finditer(p, r.text))
        assert r.n_chars == len(r.text) and (r.text == rows[3][i].text or "[" in r.text)
    assert set(rows[5]) == set(rows[4]) and all(r.taken <= 2 * r["size"] for r in rows[5].values())


def test_no_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"] and out.count() == 0
