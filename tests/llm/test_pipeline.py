import zlib

import corpus_pipeline
from tidemark.llm import pipeline
from tidemark.llm.common import stage


def test_stages_keep_columns_and_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "123", "en", "x", 3)], docs.schema)
    docs, sizes = stage(docs.unionByName(extra), "t"), []
    for name, fn in corpus_pipeline.STAGES:
        out = stage(fn(spark, docs, sf), "t")
        sizes.append(out.count())
        if name != "packing":
            assert out.columns == docs.columns and out.select("doc_id").distinct().count() == sizes[-1]
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    assert not {9001, 9002} & {r.doc_id for r in docs.collect()}
    whole = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in out.collect()} == whole.keys() and all(r.offset + r.length <= 2048 for r in out.collect())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] > 0.5 * sizes[0]
    assert all(zlib.crc32(b"") <= r.ids_crc32 < 1 << 32 for r in out.collect())


def test_empty_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, fn in corpus_pipeline.STAGES:
        assert fn(spark, docs, "").count() == 0


def test_mixing_keeps_languages_without_a_share(spark):
    """The shares of the stage add up to 1; documents of a fifth language keep the share of the tokens they have."""
    words = ["harbour", "lantern", "orchard", "meadow", "granite", "whistle", "copper", "velvet"]
    rows = [(i, " ".join(words[(i * 7 + k * (1 + i % 5)) % 8] for k in range(50)), lang, "s", 1) for i, lang in enumerate(["en", "fr", "de", "es", "it"] * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sum(pipeline.LANGUAGES.values()) == 1.0
    got = {r.lang: r["count"] for r in pipeline.mixture(spark, docs, "").groupBy("lang").count().collect()}
    assert got.keys() == {"en", "fr", "de", "es", "it"} and got["it"] > 100
