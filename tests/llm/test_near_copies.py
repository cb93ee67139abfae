"""The pipeline's near-duplicate stage against all pairs compared by hand."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import near_copies, simhash
from tests.llm.fixtures import frame

WORDS = [f"w{i}" for i in range(3000)]


def by_hand(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def planted():
    """Originals, copies with 0.8 to 0.95 in common, some just below, and one large group around a text."""
    rng, out = random.Random(3), []
    for i in range(40):
        words = rng.choices(WORDS, k=rng.randint(150, 300))
        out.append(words)
        for changes in (1, 2, 3, 5, 9):
            copy = list(words)
            for at in rng.sample(range(len(words)), changes):
                copy[at] = "new"
            out.append(copy)
    centre = rng.choices(WORDS, k=200)
    for i in range(60):
        copy = list(centre)
        for at in rng.sample(range(200), 3):
            copy[at] = f"v{i}"
        out.append(copy)
    rng.shuffle(out)
    return [" ".join(w) for w in out]


def kept_by_hand(texts):
    sets, parent = [by_hand(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    middle = 0
    for i, j in combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        either = len(sets[i] | sets[j])
        if 5 * common >= 4 * either:
            middle += 80 * either <= 100 * common <= 95 * either
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    assert middle > 100
    return {i for i in range(len(texts)) if root(i) == i}


@pytest.mark.parametrize("paired", [near_copies.PAIRED, 1])
def test_planted_copies_go(spark, monkeypatch, paired):
    monkeypatch.setattr(near_copies.near_links, "__defaults__", (paired,))
    texts = planted()
    data = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    want = kept_by_hand(texts)
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    assert {r.doc_id for r in stage(spark, frame(spark, data), "").collect()} == want
    closer = simhash.near_duplicates(frame(spark, data)).where(F.col("doc_id") == F.col("component_id")).count()
    assert closer > len(want)  # what 3 bits leave


def test_ids_that_repeat_or_miss(spark):
    """Rows are told apart by id and text; each component keeps one row, repeated rows one of them."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [
        (1, a, "s", "x"), (1, b, "s", "x"), (1, a, "s", "x"), (2, a + " more", "s", "x"),  # two texts of one id
        (None, c, "s", "x"), (None, c.upper(), "s", "x"), (None, None, "s", "x"), (None, "", "s", "x"),  # no ids
        (7, b + " more", "s", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sid string, root string").repartition(3)
    out = near_copies.keep_one_each(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "").lower()) for r in out.collect())
    assert got == sorted([(1, a), (1, b), (0, c), (0, "")])
    assert near_copies.keep_one_each(docs.limit(0)).count() == 0


def test_simhash_names_the_first_candidates(spark, monkeypatch):
    """The stage takes its fingerprints and balls from simhash.py; texts that only their repeated lines make alike stay."""
    rng, calls = random.Random(5), []
    real = simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda df, *a: calls.append(df.count()) or real(df, *a))
    words = rng.choices(WORDS, k=600)
    apart = lambda a, b: (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()
    text = " ".join(words)
    copies = (" ".join([*words[:at], "new", *words[at + 1:]]) for at in range(600))
    copy = next(c for c in copies if 0 < apart(text, c) <= simhash.RADIUS)
    line = rng.choices(WORDS, k=7) * 400
    full = [" ".join([*line, *rng.choices(WORDS, k=8)]) for _ in range(2)]
    assert apart(*full) <= simhash.RADIUS
    out = near_copies.keep_one_each(frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate([text, copy, *full])]))
    assert {r.doc_id for r in out.collect()} == {0, 2, 3} and calls == [len({simhash.fingerprint(t) for t in [text, copy, *full]})]


def test_batches_of_texts_are_small_and_the_setting_returns(spark, monkeypatch):
    """Tables with texts only; the cells of fingerprints keep the batches they had."""
    seen, before = {}, spark.conf.get(near_copies.BATCH_KEY)
    real = near_copies.materialize
    monkeypatch.setattr(near_copies, "materialize", lambda df, n: seen.update({n: spark.conf.get(near_copies.BATCH_KEY)}) or real(df, n))
    texts = ["a b c d e f", "a b c d e f a b c d e f"]
    near_copies.keep_one_each(frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])).collect()
    assert seen["near-prints"] == str(near_copies.BATCH_ROWS) and seen["near-balls"] == before
    assert spark.conf.get(near_copies.BATCH_KEY) == before
