"""Alignment of two tokenizers against a plain one, document by document."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import alignment as al

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
WORDS = "the of thetion ing été ß a's don't I'll 12 3.5 x=y; <|endoftext|> <s> </s> <unk> naïve 漢字 🙂 zero​width é ﻿bom".split()
BETWEEN = [" ", " ", " ", " ", "  ", "   ", "\n", " \n", "\n ", "\t", " ", "  ", "  ", "\r\n", "\x0b", "\x1c ", " \x85", "　"]


@pytest.fixture(scope="module")
def tokens():
    paths = al.default_tokenizers()
    return al.TokensA(paths[0]), al.TokensB(paths[1])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["".join(rng.choice(BETWEEN) + rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    out += ["".join(rng.choice(WORDS) + rng.choice(BETWEEN) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    out += ["", " ", "  ", "\n", " a", "a ", "a  ", "  a  b  ", "a▁b", "▁", "\x00", "tab\tin", "x" * 3000, "ab " * 5000, "the same", "the same", " ", "  x"]
    return out + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2070), rng.randrange(0x3000, 0x3040), 0x1F600])) for _ in range(80)) for _ in range(200)]


def brute(rows, tokens):
    """What the contract says, one document at a time."""
    found, held = [], Counter()
    for doc_id, text in rows:
        groups, links = [], []
        if text:
            whole = (" " + text).encode()
            spans = []
            for side in tokens:
                ids = side.encode([" " + text])[0]
                ends = np.cumsum([len(side.bytes[i]) for i in ids]).tolist()
                spans.append((b"".join(side.bytes[i] for i in ids), [(i, a, z) for i, a, z in zip(ids, [0, *ends], ends, strict=False)]))
            if all(joined == whole for joined, _ in spans):
                (_, a), (_, b) = spans
                links = [(i, j) for i, x, y in a for j, v, w in b if x < w and v < y] if len(a) * len(b) < 10**6 else sweep(a, b)
                cuts = sorted({z for *_, z in a} & {z for *_, z in b})
                for low, high in zip([0, *cuts], cuts, strict=False):
                    groups.append("|".join(",".join(str(i) for i, x, z in side if low < z <= high) for side in (a, b)) if len(cuts) < 2000 else None)
                groups = groups if None not in groups else by_cut(a, b, cuts)
                found.append((doc_id, len(a), len(b), groups, links))
                held.update(set(links))
                continue
        found.append((doc_id, 0, 0, [], []))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (((-1 if d is None else d), na, nb, len(g), len(ls), sum(held[x] == best[x[0]] for x in ls), sum(held[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, ls in found),
        key=str,
    )


def sweep(a, b):
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        y, w = a[i][2], b[j][2]
        i, j = i + (y <= w), j + (w <= y)
    return out


def by_cut(a, b, cuts):
    out, i, j = [], 0, 0
    for cut in cuts:
        parts = []
        for side, at in ((a, i), (b, j)):
            end = at
            while end < len(side) and side[end][2] <= cut:
                end += 1
            parts.append((",".join(str(x[0]) for x in side[at:end]), end))
        (left, i), (right, j) = parts
        out.append(f"{left}|{right}")
    return out


def result(df):
    return sorted((tuple(-1 if x is None else x for x in r) for r in al.aligned(df).select(COLUMNS).collect()), key=str)


def test_by_brute_force(spark, texts, tokens, clashing):
    rows = [(i, x) for i, x in enumerate(texts)] + [(None, "no id the same"), (None, None), (9, None), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute(rows, tokens)
    assert any(r[4] > r[3] > 1 for r in expected) and any(r[1] == 0 and r[0] > 0 for r in expected)
    assert result(df) == expected
    more = clashing(df).select("*", *[F.lit("x").alias(c) for c in ("pair", "block", "count", "at", "counts", "n_a")])
    assert result(more) == expected


def test_stretches_and_forgetting(texts, tokens, monkeypatch):
    """Whatever is remembered and however texts are batched, ids are those of whole texts."""
    import pyarrow as pa

    monkeypatch.setattr(al, "REMEMBERED", 50)
    monkeypatch.setattr(al, "KEPT", 20)
    monkeypatch.setattr(al, "JOINED", 7)
    aligner = al.Aligner(*al.default_tokenizers())
    for size in (1, 5, 200, len(texts)):
        for at in range(0, len(texts), size):
            some = texts[at : at + size]
            found = aligner.batch(pa.array(some))
            for k, x in enumerate(some):
                a, b = (side.encode([" " + x])[0] if x else [] for side in tokens)
                right = all(b"".join(side.bytes[i] for i in ids) == (" " + x if x else "").encode() for side, ids in zip(tokens, (a, b), strict=True))
                assert (found["n_a"][k], found["n_b"][k]) == ((len(a), len(b)) if right else (0, 0)), x


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []
    assert result(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_as_text(tokens):
    """The hashed text of one document, written out."""
    import pyarrow as pa

    aligner = al.Aligner(*al.default_tokenizers())
    found = aligner.batch(pa.array(["the cat"]))
    a, b = (side.encode([" the cat"])[0] for side in tokens)
    assert len(a) == len(b) == 2 and found["sha"] == [hashlib.sha256(f"{a[0]}|{b[0]};{a[1]}|{b[1]}".encode()).hexdigest()]
