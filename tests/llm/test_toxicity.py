import random
from zlib import crc32

import numpy as np

from quarry.llm.toxicity import Model, fit, score

INSULTS = "zorg blat frem quix".split()


def corpus():
    random.seed(8)
    vocabulary = ["".join(random.choices("aeioulmnrst", k=random.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 7 == 0
        words = random.choices(vocabulary, k=random.randint(20, 150))
        if toxic:
            for _ in range(len(words) // 12 + 1):
                words[random.randrange(len(words))] = random.choice(INSULTS)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame([(i, y, "x") for i, y in labels], "doc_id long, toxic int, text string")
    found = {r.doc_id: r for r in score(docs, fit(docs, marks)).collect()}
    kept = [i for i, _ in labels if crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (crc32(str(i).encode()) % 5 == 0) for i in found)
    truth, said = np.array([labels[i][1] for i in kept]), np.array([found[i].predicted for i in kept])
    assert (truth == said).mean() > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.terms == b.terms and a.stems == b.stems and np.allclose(a.weights, b.weights)


def test_odd_rows(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([*labels, (3, None), (None, 1), (5, 0), (5, 1), (99999, 1)], "doc_id long, toxic int"))
    odd = [(1, None), (2, ""), (3, "zorg " * 40_000), (3, "zorg " * 40_000), (None, "zorg blat frem")]
    got = score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(got) == 5 and {r.score for r in got if r.doc_id in (1, 2)}.__len__() == 1
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert score(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score(docs, fit(docs, none)).count() == 2
    assert score(docs, fit(docs.limit(0), none)).count() == 2


def test_label_model_recovers_precisions():
    random_ = np.random.default_rng(1)
    toxic = random_.random(60_000) < 0.2
    true, false = np.array([0.7, 0.5, 0.6, 0.8]), np.array([0.02, 0.1, 0.01, 0.05])
    votes = random_.random((60_000, 4)) < np.where(toxic[:, None], true, false)
    model = Model([b"a", b"b", b"c", b"d"], [], 0.2)
    pad = model.voters - 4
    pairs = {(j, k): int((votes[:, j] & votes[:, k]).sum()) for k in range(4) for j in range(k)}
    triples = {(j, k, m): int((votes[:, j] & votes[:, k] & votes[:, m]).sum()) for m in range(4) for k in range(m) for j in range(k)}
    model.learn_accuracies(60_000, np.append(votes.sum(axis=0), np.zeros(pad, int)), pairs, triples)
    want = [(toxic & votes[:, j]).sum() / votes[:, j].sum() for j in range(4)]
    assert np.abs(model.precision[:4] - want).max() < 0.1
    assert (model.share[4:] == 0).all()


def plain_votes(model, text):
    """The votes of a text, by the voters' definition, one at a time."""
    import re

    from quarry.llm.line_dedup import FOLD
    from quarry.llm.toxicity import PATTERNS, STEM_EVERY

    raw = (text or "").encode()
    words = raw.translate(FOLD).split()
    out = [term in words for term in model.terms]
    for stem in model.stems:
        for third in range(3):
            part = words[len(words) * third // 3 : len(words) * (third + 1) // 3]
            hits = [w for w in part if w.startswith(stem)]
            out.append(bool(hits) and len(hits) * STEM_EVERY >= len(part))
    return np.array([*out, *(re.search(p, raw) is not None for p in PATTERNS.values())])


def test_against_brute_force(spark):
    """The label model from a matrix of all votes, and every score from the weights, both written out plainly."""
    from itertools import combinations

    from quarry.llm.toxicity import DIMENSIONS, FOLD

    rows, labels = corpus()
    rows += [(10_000, None), (10_001, ""), (10_002, "you idiot " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    votes = np.array([plain_votes(model, t) for _, t in rows])
    single = votes.sum(axis=0)
    fired = [i for i in range(model.voters) if single[i]]
    pairs = {(j, k): n for j, k in combinations(fired, 2) if (n := int((votes[:, j] & votes[:, k]).sum()))}
    triples = {x: n for x in combinations(fired, 3) if (n := int(votes[:, list(x)].all(axis=1).sum()))}
    again = Model(model.terms, model.stems, model.prior)
    again.learn_accuracies(len(rows), single, pairs, triples)
    assert np.allclose(again.precision, model.precision) and np.allclose(again.share, model.share)
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    for (i, text), row in zip(rows, votes):
        hashed = {crc32(w) % DIMENSIONS for w in set((text or "").encode().translate(FOLD).split())}
        logit = model.bias + model.weights[: model.voters][row].sum() + sum(model.weights[model.voters + h] for h in hashed) / max(1, len(hashed)) ** 0.5
        assert abs(got[i] - 1 / (1 + np.exp(-min(30.0, max(-30.0, logit))))) < 1e-9
