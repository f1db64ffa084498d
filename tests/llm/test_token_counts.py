import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lamina.llm import token_counts as t
from lamina.llm.storage import new_path


@pytest.fixture(scope="module")
def encoder():
    with open(t.TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_match_the_tokenizer(spark, make, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, ""), (None, "a b"), (7, None), (2**63 - 1, "<|endoftext|> x"), (-(2**63), "é" * 9000), (5, "\n\r"), (5, "\n\r")]
    docs = docs.union(make(odd))
    want = sorted(((r.doc_id, len(encoder.encode_ordinary(r.text or ""))) for r in docs.collect()), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in t.token_counts(docs).collect()), key=str) == want
    assert t.token_counts(make([])).count() == 0


@pytest.fixture
def splits(spark):
    """Splits of a few bytes, and Arrow batches of few lines."""
    keys = {"spark.sql.files.maxPartitionBytes": "90", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("chunk", "eod"), [(100, t.EOD), (1, 0x0A41)])
def test_splits_are_stitched(spark, tmp_path, splits, chunk, eod):
    """Documents over many splits, empty ones, ids that hold the cut's byte, false hits at odd bytes, an open end."""
    rng = np.random.default_rng(chunk)
    want = []
    for f, closed in enumerate([True, False, True]):
        lengths = [0, 0, 1, 2, 3, 40, 0, 7, *rng.integers(0, 9, 20).tolist(), 0]
        ids = []
        for k, n in enumerate(lengths):
            last = k == len(lengths) - 1
            want.append((f"{f}.bin", k, len(ids), n + (2 if last and not closed else 0), closed or not last))
            # many bytes of the separator and of the cut
            some = rng.choice([eod & 255, eod >> 8, 10, 32, 0, 255], (n, 2)) @ [1, 256]
            ids += [int(x) if x != eod else 1 for x in some] + ([eod] if closed or not last else [1, 2])
        np.array(ids, "<u2").tofile(tmp_path / f"{f}.bin")
    (tmp_path / "3.bin").touch()
    (tmp_path / "4.bin").write_bytes(b"\x01\x00\x02")
    want.append(("4.bin", 0, 0, 1, False))
    rows = t.separator_scan(spark, f"file://{tmp_path}", eod=eod, chunk=chunk).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.ordinal, r.start, r.n_tokens, r.closed) for r in rows) == sorted(want)


def test_heads_cross_splits(spark, make, splits):
    path = t.write_token_files(make([(i, "w\n " * i) for i in range(20)]), new_path(spark, "t"))
    rows = t.separator_scan(spark, path, header=t.HEADER, chunk=64).collect()
    assert sorted(t._doc_id(np.array(r.head)) for r in rows) == list(range(20))


def test_a_tokenizer_must_leave_the_separator_free(make, monkeypatch):
    monkeypatch.setattr(t, "EOD", 5)
    with pytest.raises(ValueError):
        t.write_token_files(make([(1, "a")]), "unused")
