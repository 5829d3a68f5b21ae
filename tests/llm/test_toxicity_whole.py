"""Toxicity learns from every labelled row: counts, training and cuts over tables that are larger than any sample."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lodestone.llm import toxicity

from .conftest import SCHEMA

LABELS = "doc_id long, quality int, toxic int"
PLAIN = [f"{a}{b}" for a in "lo mi ra su ten vor".split() for b in "na pe qui ro st".split()]


def known(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def test_rows_beyond_any_sample_are_learnt_from(spark):
    """Toxic rows that come last in the order of the bounded sample have a word of their own."""
    rng = random.Random(1)
    toxic = sorted((i for i in range(0, 14_000, 2) if known(i)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    late = set(toxic[toxicity.SAMPLE_ROWS :])
    assert len(late) > 1000
    docs, labels = [], []
    for i in range(14_000):
        words = [rng.choice(PLAIN) for _ in range(6)]
        if i % 2 == 0:
            words[rng.randrange(6)] = "snarl" if i in late or not known(i) else "grubby"
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, 1 - i % 2))
    out = toxicity.scored(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).where("held_out").collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in out) / len(out) > 0.99


@pytest.fixture(scope="module")
def some():
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(700):
        words = [rng.choice(PLAIN) for _ in range(rng.randrange(0, 40))] + ["grubby"] * (2 * (i % 3 == 0))
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), "s", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    return docs + [(3, docs[3][1], docs[3][2], "s", 1), (4, None, None, None, None)], labels


def test_counts_are_of_all_rows(spark, some):
    docs, labels = some
    blocks, n = toxicity.labelled_blocks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), 5000)
    assert n == sum(known(d[0]) for d in docs) and blocks.rdd.getNumPartitions() > 5
    read = [x for row in blocks.toArrow().to_batches() for x in toxicity.read_blocks([row])]
    assert sorted(len(t) for texts, *_ in read for t in texts) == sorted(len((d[1] or "").split()) for d in docs if known(d[0]))
    seen, count = toxicity.counted(blocks)
    want = sum(toxicity.seen_in([t for t, r in zip(texts, rest, strict=True) if not r], toxic[~rest], buckets) for texts, toxic, rest, _, buckets in read)
    assert (seen == want).all() and count.tolist() == [sum(int(((toxic == v) & ~rest).sum()) for _, toxic, rest, _, _ in read) for v in (0, 1)]
    assert 0.1 < sum(int(rest.sum()) for _, _, rest, _, _ in read) / n < 0.3


def test_one_task_alone_is_plain_training(spark, some):
    """With one task the mean of what tasks have moved is what a plain loop over the same batches gives."""
    docs, labels = some
    blocks, _ = toxicity.labelled_blocks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS), 1 << 30)
    seen, count = toxicity.counted(blocks)
    got = toxicity.trained(blocks, toxicity.Training(toxicity.begun(seen, count, np.random.default_rng(1))), 1, epochs=2)
    plain, read = toxicity.Training(toxicity.begun(seen, count, np.random.default_rng(1))), list(toxicity.read_blocks(blocks.toArrow().to_batches()))
    for epoch in range(2):
        rng = np.random.default_rng([1, epoch, 0])
        for texts, toxic, rest, _, buckets in read:
            order = rng.permutation(np.flatnonzero(~rest))
            for at in range(0, len(order), toxicity.BATCH):
                plain.step([texts[i] for i in order[at : at + toxicity.BATCH]], toxic[order[at : at + toxicity.BATCH]].astype(float), buckets, toxicity.rate_of(epoch, 2))
    assert np.allclose(got.embedding, plain.model.embedding, atol=1e-5) and np.allclose(got.dense, plain.model.dense, atol=1e-5) and got.bias == pytest.approx(plain.model.bias, abs=1e-5)


def test_the_model_does_not_depend_on_the_split_or_on_held_out_labels(spark, some):
    docs, labels = some
    flipped = [(i, q, t if known(i) else 1 - t) for i, q, t in labels]
    a = toxicity.learned(spark.createDataFrame(docs, SCHEMA).repartition(1), spark.createDataFrame(labels, LABELS), size=8000)
    b = toxicity.learned(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7), spark.createDataFrame(flipped, LABELS), size=8000)
    assert a.embedding.tobytes() == b.embedding.tobytes() and a.dense.tobytes() == b.dense.tobytes() and (a.bias, a.shift, a.thresholds) == (b.bias, b.shift, b.thresholds)


def test_cuts(spark):
    rng = np.random.default_rng(4)
    rows = [(lang, int(t), float(np.round(rng.normal(3 * t + shift, 2), digits))) for lang, shift, n, digits in (("en", 0, 400, 8), ("de", 2, 300, 1), ("fr", 0, 15, 8), (None, -1, 50, 0)) for t in rng.integers(0, 2, n)]
    rows += [("es", 1, -80.0)] * 30
    got = toxicity.cuts(spark.createDataFrame(rows, "lang string, toxic int, logit double").repartition(4))
    assert set(got) == {None, "en", "de"}
    for lang, cut in got.items():
        of = [(t, x) for k, t, x in rows if lang in (None, k)]
        f1 = lambda c: 2 * sum(t for t, x in of if x >= c) / (sum(x >= c for _, x in of) + sum(t for t, _ in of))
        assert f1(cut) == pytest.approx(max(f1(x) for _, x in of))
    only = [(x, t) for k, t, x in rows if k == "en"]
    assert got["en"] == pytest.approx(toxicity.best_threshold(np.array([x for x, _ in only]), np.array([t for _, t in only])))


def test_marked_rows_are_a_superset(spark, monkeypatch):
    """All known rows pass, whatever the bitmap's size, and few others."""
    rows, ids = spark.range(-3000, 3000).withColumnRenamed("id", "doc_id"), spark.range(-3000, 3000, 4).withColumnRenamed("id", "doc_id")
    for bits, most in ((25, 1510), (6, 6000)):
        monkeypatch.setattr(toxicity, "BITS", bits)
        passed = [r.doc_id for r in toxicity.marked(rows, ids).collect()]
        assert set(range(-3000, 3000, 4)) <= set(passed) and len(passed) == len(set(passed)) <= most


def test_blocks_of_which_no_text_calibrates(spark, some):
    """A long text is a block of its own, and most of these train."""
    docs, labels = some
    long = [(1000 + i, "q" * 1_200_000, "en", "s", 1) for i in range(12)]
    model = toxicity.learned(spark.createDataFrame(docs + long, SCHEMA), spark.createDataFrame(labels + [(d[0], 1, 0) for d in long], LABELS))
    assert model.shift != 0 and model.dense.any()
