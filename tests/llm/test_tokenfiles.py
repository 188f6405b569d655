import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, tokenfiles
from tidemark.llm.common import scratch


@pytest.mark.parametrize("block", [16, 62, 1 << 20])
def test_documents_across_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    x = rng.integers(0, 9, 4000).astype("<u2")
    x[500:900] = 3  # a document over many blocks
    x.tofile(tmp_path / "a.tokens")
    np.array([], "<u2").tofile(tmp_path / "empty.tokens")
    np.array([0, 0, 5], "<u2").tofile(tmp_path / "b.tokens")
    want = set()
    for name, v in (("a", x), ("b", np.array([0, 0, 5]))):
        cut = np.flatnonzero(v == 0)
        start = np.r_[0, cut + 1]
        want |= {(f"{name}.tokens", i, int(start[i]), int(e - start[i]), True) for i, e in enumerate(cut)}
        if start[-1] < len(v):
            want.add((f"{name}.tokens", len(cut), int(start[-1]), int(len(v) - start[-1]), False))
    got = tokenfiles.token_counts(spark, f"file://{tmp_path}", 0, block=block, group=7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_counts_are_the_tokenizers(spark):
    sf = "/root/testdata/sf0.01"
    whole = Tokenizer.from_file(queries.vocabulary())
    whole.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: len(whole.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    got = queries.op1_tokens(spark, sf).collect()
    assert {r.doc_id: r.tokens for r in got} == want and len(got) == len(docs)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "<|endoftext|>"), (5, "cat " * 40000), (5, "cat")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, file string").coalesce(1)
    folder = scratch(spark, "t")
    named = tokenfiles.write_token_files(df, folder, queries.vocabulary(), 65535, file_bytes=1000).collect()
    got = tokenfiles.token_counts(spark, folder, 65535, block=4096).collect()
    n = {(r.file, r.doc_no): r.tokens for r in got}
    assert [n[r.file, r.doc_no] for r in named] == [0, 0, 2, n[named[3].file, named[3].doc_no], 40000, 1] and all(r.whole for r in got)
    assert n[named[3].file, named[3].doc_no] > 1
    assert tokenfiles.write_token_files(df.limit(0), scratch(spark, "t"), queries.vocabulary(), 65535).collect() == []
