"""Training of the language model with the registered settings."""

import zlib

import numpy as np
import zstandard

from tramlines.llm import maxent


def test_every_position_is_observed(spark, make, prose):
    docs = make([(i, prose(i, 50 + i, 60)) for i in range(40)])
    model = maxent.start_model(maxent.token_counts(docs), maxent.Shape())
    rows = docs.select("text").mapInArrow(maxent._observe(spark.sparkContext.broadcast(model)), maxent.COUNTS).collect()
    total = [sum(int(np.frombuffer(zstandard.decompress(r.counts), "<i4").sum()) for r in rows if r.block // maxent.BLOCKS == k) for k in range(3)]
    ends = 40  # the end token is a word of the model like others
    assert model.n == sum(50 + i for i in range(40)) + ends
    assert total == [model.n * len(which) for which in maxent.FEATURES]


def test_registered_shape_gains(make, prose):
    rows = [(i, prose(i % 7, 300, 50)) for i in range(60)]
    docs = make(rows)
    learn = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 7 != 2")
    counts = maxent.token_counts(learn)
    out = maxent.score(docs, maxent.train(learn, counts), counts).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert held and sum(r.score for r in held) > 0.6 * sum(r.base_score for r in held)  # whole copies are in the training part


def test_probabilities_of_all_tokens_sum_to_one(make, prose):
    """By hand from the factors: over all words and shapes, unseen tokens included, in any context."""
    docs = make([(i, prose(i, 200, 300) + " été naïve größe" * (i % 3)) for i in range(30)])
    counts = maxent.token_counts(docs)
    shape = maxent.Shape(groups=4, classes=4, each=4, head=1 << 10)
    model = maxent.applied(maxent.train(docs, counts, shape))
    rng = np.random.default_rng(0)
    feats = rng.integers(0, 1 << 63, (20, 5)).astype(np.uint64)
    feats[:5] = maxent.contexts(np.array([1, 2, 3, 4, 5]), np.zeros(5, np.int64), np.array([0, 5]), np.arange(5))
    at = lambda k, node: np.exp(maxent.outcomes(model.factors[k], maxent.FEATURES[k], feats, np.full(20, node)))
    first = at(0, 0)
    total = first[:, shape.groups :].sum(1)
    for g in range(shape.groups):
        middle = at(1, g)
        for c in range(shape.classes):
            total += first[:, g] * middle[:, c] * at(2, g * shape.classes + c).sum(1)
    assert np.allclose(total, 1, atol=1e-4)
    # Inside a shape class: its tokens outside the words, with one place for all unseen ones.
    words = set(model.vocabulary.keys.tolist())
    for s in range(maxent.SHAPES):
        rest = [r["count"] + 1 for r in counts.where(f"shape = {s}").collect() if r["token"] % (1 << 64) not in words]
        assert np.isclose(sum(rest) + 1, model.shape_total[s])


def test_places_without_a_word_have_no_probability(make):
    docs = make([(1, "a b c"), (2, "a b")])
    model = maxent.applied(maxent.train(docs, maxent.token_counts(docs)))
    f = model.factors[2]
    p = np.exp(maxent.outcomes(f, maxent.FEATURES[2], np.ones((1, 5), np.uint64), np.array([0])))
    assert np.isclose(p[0, :4].sum(), 1) and (p[0, 4:] == 0).all()
