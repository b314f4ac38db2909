"""Language identification against a plain version, and its bounds."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DE, DOCS, EN, ES, FR, prose
from tidemark.llm import langid

LANGS = {"en": EN, "de": DE, "fr": FR, "es": ES}


def plain_features(text):
    """Counts gram by gram, in Python's own numbers."""
    raw, out = text.lower().encode("utf-8", "replace"), [0] * langid.WIDTH
    for n, add, mul in ((1, 0, 2654435761), (2, 77, 2246822519), (3, 1234567, 3266489917)):
        for i in range(len(raw) - n + 1):
            out[((int.from_bytes(raw[i:i + n], "big") + add) * mul % 2**32) >> 20] += 1
    x = np.sqrt(np.array(out, dtype=float))
    return x / np.sqrt((x**2).sum())


def plain_vote(x, weights, langs):
    """The families' best, then every pair's vote, one margin at a time."""
    families = sorted({langid.family(c) for c in langs})
    margin = lambda k: float(np.dot(weights[k, :-1], x) + weights[k, -1])
    k, best = 0, None
    if len(families) > 1:
        best = max(range(len(families)), key=lambda i: (margin(i), -i))
        k = len(families)
    name = families[best or 0]
    pairs = [(a, b) for f in families for a, b in combinations([c for c in sorted(langs) if langid.family(c) == f], 2)]
    votes = {c: [0, 0.0] for c in langs if langid.family(c) == name}
    for i, (a, b) in enumerate(pairs):
        if a in votes:
            m = margin(k + i)
            p = 1 / (1 + np.exp(-4 * m))
            votes[a if m >= 0 else b][0] += 1
            votes[a][1] += p
            votes[b][1] += 1 - p
    return max(votes, key=lambda c: (votes[c][0], votes[c][1], c))


@pytest.mark.parametrize("text", ["a", "ab", "Héllo wörld, the of and", "ÀÉ 12 " * 50, "日本語 text"])
def test_features_are_the_plain_ones(text):
    assert np.allclose(langid.features(text), plain_features(text), atol=1e-6)


def test_long_texts_are_read_whole():
    text = "the of and " * 120_000 + "zq" * 300_000
    assert np.allclose(langid.features(text)[:50], plain_features(text)[:50], atol=1e-6)


def test_machines_separate_and_votes_are_the_plain_ones():
    rng = random.Random(5)
    labels = np.array([c for c in LANGS for _ in range(40)])
    x = np.array([langid.features(prose(rng, LANGS[c], 30)) for c in labels])
    todo = langid.machines(sorted(LANGS))
    assert todo == [("germanic",), ("romance",), ("de", "en"), ("es", "fr")]
    weights = np.array([langid.train(x, labels, m) for m in todo])
    # the primal objective by plain gradient descent from zero comes no lower than the dual's by more than 5 %
    for w, m in zip(weights.astype(float), todo):
        some = np.ones(len(labels), bool) if len(m) == 1 else np.isin(labels, m)
        y = np.where(np.array([langid.family(c) if len(m) == 1 else c for c in labels[some]]) == m[0], 1.0, -1.0)
        xs = np.concatenate([x[some], np.ones((some.sum(), 1))], axis=1)
        cost = np.where(y > 0, langid.COST * len(y) / (2 * (y > 0).sum()), langid.COST * len(y) / (2 * (y < 0).sum()))

        def loss(v):
            return 0.5 * (v @ v) + (cost * np.maximum(0, 1 - y * (xs @ v)) ** 2).sum()

        v = np.zeros(xs.shape[1])
        for _ in range(4000):
            v -= 2e-4 * (v - 2 * xs.T @ (cost * y * np.maximum(0, 1 - y * (xs @ v))))
        assert loss(w) <= 1.05 * loss(v)
    model = langid.Model(set(LANGS), weights)
    texts = [prose(rng, LANGS[c], n) for c in LANGS for n in (1, 3, 30)] + ["x", "日本", "der la the of"]
    got = model.predict(np.array([langid.features(t) for t in texts]))
    assert [c for c, _ in got] == [plain_vote(plain_features(t), weights.astype(float), list(LANGS)) for t in texts]


def test_three_hundred_languages(spark):
    """Dirty labels teach like others and raise nothing; the sample stays within its bound."""
    rng = random.Random(3)
    rows = [(i, prose(rng, LANGS[c], 20), c, "s", 0) for i in range(400) for c in [rng.choice(list(LANGS))]]
    rows += [(1000 + i, f"w{i} " * 5 + prose(rng, EN, 3), f"x{i // 2}", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    assert langid.sample(docs, "doc_id", "text", "lang", 500).groupBy("lang").count().agg(F.max("count")).first()[0] <= langid.MOST_ROWS // 304
    model = langid.fit(docs, per_lang=5)
    assert len(model.langs) == 304
    assert langid.identify(docs, model).count() == len(rows)


def test_letterless_rows_and_hot_ids_do_not_crowd_a_language_out(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, LANGS[c], 30), c, "s", 0) for i in range(300) for c in [("en", "de", "fr", "es")[i % 4]]]
    rows += [(1000 + i, "123", "es", "s", 0) for i in range(20_000)] + [(None, "the same text", "en", "s", 0)] * 2000
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs, per_lang=50)
    assert model.langs == ["de", "en", "es", "fr"]
    taken = {r.lang: r["count"] for r in langid.sample(docs, "doc_id", "text", "lang", 50).groupBy("lang").count().collect()}
    assert taken["es"] == 50 and taken["de"] == 50


def test_stage_keeps_unlabelled_corpora_and_uses_scores(spark, odd_docs, no_docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, LANGS[c], 30), c, "s", 0) for i in range(120) for c in [("en", "de", "fr", "es")[i % 4]]]
    rows += [(500, None, None, None, None), (501, "12 !", "en", "s", 0), (7, rows[7][1], "fr", "s", 0), (7, rows[7][1], "fr", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("lang_pred", F.lit(1))
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == 122 and ids.count(7) == 3 and not {500, 501} & set(ids)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(bare).count() == 122
    model = langid.fit(docs.where(~langid.held_out()))
    scores = {r.doc_id: r.score for r in langid.identify(docs, model).collect()}
    limit = sorted(scores.values())[20]
    assert {r.doc_id for r in langid.keep_identified(docs, least=limit).collect()} == {i for i, s in scores.items() if s >= limit}
    assert langid.keep_identified(no_docs).count() == 0 and langid.fit(no_docs) is None
    assert {4, 5, 6}.isdisjoint(r.doc_id for r in langid.keep_identified(odd_docs).collect())


def test_repeats_and_ties(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, LANGS[c], 20), c, "s", 0) for i in range(80) for c in [("en", "de")[i % 2]]]
    docs = spark.createDataFrame(rows + rows[:20], DOCS)
    got = [tuple(r) for r in langid.op4_language_id(docs).collect()]
    assert len(got) == 100 and all(got.count(r) == (2 if r[0] < 20 else 1) for r in got)
    for i, held, *_ in got:
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1)
