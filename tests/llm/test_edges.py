"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers
from driftline.llm import ann, bpe, html_text, langid, line_dedup, mixing, quality, sharding, simhash, toxicity
from tests.llm.fixtures import AWKWARD, frame, rows

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, rows(30) + AWKWARD).cache()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def operators(spark, vocabulary):
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(30)] + [(None, 1, None), (1000, 1, 1)], LABELS)
    return {
        "quality": lambda d: quality.quality(d),
        "toxicity": lambda d: toxicity.score_documents(d, toxicity.fit(d, labels, F.lit(True))),
        "simhash": lambda d: simhash.near_duplicates(d),
        "langid": lambda d: langid.predict(d, langid.fit(d, ~langid.held_out(5, 0))),
        "line_dedup": lambda d: line_dedup.dedup_lines(d),
        "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, vocabulary, public_tokenizers.PATTERN), vocabulary),
        "sharding": lambda d: sharding.shard_documents(d),
    }


NAMES = ("quality", "toxicity", "simhash", "langid", "line_dedup", "bpe", "sharding")


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_are_kept(spark, docs, vocabulary, name):
    out = operators(spark, vocabulary)[name](docs)
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, vocabulary, name):
    assert operators(spark, vocabulary)[name](docs.limit(0)).count() == 0


CLASHES = (
    "n_words posterior kept base_failed score predicted fp component_id lang_pred bits_per_byte n_lines n_dropped tokens "
    "n_tokens decoded size text_crc32 shard slot copy shuffle_key count key value h1 pos line"
).split()


@pytest.mark.parametrize("name", [*NAMES, "mixing"])
def test_clashing_names(spark, docs, vocabulary, name):
    more = docs.select("*", *[F.lit("mine").alias(c) for c in CLASHES])
    run = {**operators(spark, vocabulary), "mixing": mixing.mix_sources}[name]
    plain, clashing = run(docs), run(more)
    added = sorted(set(plain.columns) - {"text"})
    left, right = (sorted(map(str, d.select(*added).collect())) for d in (plain, clashing))
    assert left == right
    if "mine" in clashing.columns:
        assert clashing.where("mine <> 'mine'").count() == 0


def test_equal_rows_get_equal_results(spark, docs, vocabulary):
    for name, run in operators(spark, vocabulary).items():
        if name == "sharding":
            continue
        out = run(docs).where("doc_id in (1007, 1008)").drop("doc_id")
        assert len({str(r) for r in out.collect()}) == 1, name


def test_mixing_awkward(spark, docs):
    out = mixing.mix_sources(docs, budget=20.0)
    assert out.where("doc_id is null").count() > 0 and out.where("source is null").count() > 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    twice = out.where("doc_id = 1008").groupBy("copy").count().collect()
    assert twice and all(r["count"] == 2 for r in twice)


def test_nearest_awkward(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]),
            (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 1.0, 1.0]), (50, [0.6, 0.8]), (50, [0.6, 0.8]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("query", F.lit("mine"))
    out = ann.nearest(df).orderBy("query_id", "rank").collect()
    assert [(r[0], r[1], r[2]) for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 3), (50, 2, 0), (50, 3, 1), (50, 4, 2)]
    assert ann.nearest(df.limit(0)).count() == 0
    assert ann.nearest(df.where("vec_id = 0")).count() == 0


def test_html_awkward(spark):
    data = [(1, None, None), (2, "u", ""), (3, "u", "<p>a<p>b &amp;&nbsp;c"), (4, "u", "<div><nav>x</nav>"), (5, "u", "<<>&#xZZ;</p></x>"),
            (6, "u", "<article>" + "<p>w</p>" * 20_000 + "</article>"), (6, "u", "<b>t"), (None, "u", "<!-- open <p>z")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {(r.page_id, r.text) for r in html_text.extract(df.withColumn("text", F.lit("mine"))).collect()}
    assert {(1, ""), (2, ""), (3, "a b & c"), (4, ""), (6, "t"), (6, " ".join("w" * 20_000))} <= got and len(got) == 8
    assert html_text.extract(df.limit(0)).count() == 0


def test_pipeline_awkward(spark, docs):
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").where("not restored").count() == 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
