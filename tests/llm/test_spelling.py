"""Spelling variants against counting and comparing all words in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.llm import spelling

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def is_near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[at + 1 :] == (b[at + 1 :] if len(a) == len(b) else b[at:])


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [u for u in n if is_near(w, u)] for w in n}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def result(df, **more):
    return {tuple(r) for r in spelling.variants(df, **more).select(COLUMNS).collect()}


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(3)
    syllables = ["tion", "ing", "the", "é", "ßa", "ou", "×l"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 5))) for _ in range(30)]
    base += ["abcdefgh", "bacdefgh", "abcdefhg", "aabbccdd", "a" * 9, "a" * 10, "ab" * 400, "ab" * 399 + "a"]

    def changed(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abté") + w[i:], w[:i] + rng.choice("abté") + w[i + 1 :]])

    rows = []
    for i in range(300):
        some = [w if rng.random() < 0.8 else changed(w) for w in rng.choices(base, [1 / (k + 1) ** 2 for k in range(len(base))], k=30)]
        rows.append((i, rng.choice([" ", "-", "\n", "0", "Ā"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in some)))
    # chains of forms: 2, 20, 200 and 2000 times
    chain = ["chainedzzz", "chainedzzy", "chainedzxy", "chainedwxy"]
    rows += [(1000 + k, " ".join([w] * 2 * 10**k)) for k, w in enumerate(chain)]
    return rows + [(None, None), (7, None), (8, ""), (None, "withoutid withoutid"), rows[0], rows[0]]


def test_words_by_brute_force(spark, spelled, clashing):
    df = spark.createDataFrame(spelled, "doc_id long, text string").repartition(3)
    expected = brute(spelled)
    assert len({r for r in expected if r[1]}) > 10 and any(r[2] not in (r[0], r[1]) for r in expected)
    assert result(df) == expected
    assert result(clashing(df).withColumn("word", F.lit(1)).withColumn("root", F.lit("x"))) == expected


def test_keys_with_many_words(spark, spelled):
    df = spark.createDataFrame(spelled, "doc_id long, text string")
    assert result(df, small=1) == brute(spelled)
    # permutations of eight letters all have one key; few of their changes are near each other
    rng = random.Random(5)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(300)}
    words |= {w[:3] + rng.choice("xyz") + w[4:] for w in sorted(words)} | {w[:5] + w[6:] for w in sorted(words)}
    rows = [(i, f"{w} {w} {w}") for i, w in enumerate(sorted(words))]
    assert result(spark.createDataFrame(rows, "doc_id long, text string"), small=20) == brute(rows)


def test_empty_and_long(spark):
    assert result(spark.createDataFrame([], "doc_id long, text string")) == set()
    assert result(spark.createDataFrame([(1, None), (2, ""), (3, "short words only")], "doc_id long, text string")) == set()
    long = "qwertzuiop" * 30_000
    rows = [(1, f"{long} {long} {long[1:]}.{long[1:]}")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_values_of_letters(spark):
    """No two different exchanges change a key alike, so a pair meets once."""
    codes = [*range(97, 123), *range(65, 91), *range(0xC0, 0x100)]
    sums = Counter(a**5 + b**5 for i, a in enumerate(codes) for b in codes[i:])
    assert max(sums.values()) == 1
    key = spark.range(1).select(spelling.anagram_key(F.lit("abÿ"))).first()[0]
    assert key == 97**5 + 98**5 + 255**5


def test_sql(spark, spelled):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame(spelled, columns=["doc_id", "text"]).astype({"doc_id": "Int64"})  # noqa: F841  read by the SQL
    found = duckdb.sql(spelling.oracle()).fetchall()
    columns = [c[0] for c in duckdb.sql(spelling.oracle()).description]
    without = {tuple(r[columns.index(c)] for c in COLUMNS) for r in found}
    assert without == brute(spelled)
