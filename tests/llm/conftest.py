import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use for results of their own.
CLASHING = ["kept", "score", "fingerprint", "component_id", "sequence_id", "offset", "length", "piece", "block", "slot", "class", "norm", "md5", "row", "verdict", "host", "spans", "n_words",
            "_row", "_carried", "_q", "_key", "_class", "_none", "_rank", "_start", "_bucket", "_n", "_sha", "_doc", "_tie", "_all", "_stay", "_share", "_frame", "_job", "slot_in_frame", "mix_pos", "release", "deadline",
            "fp", "first", "root", "node", "tie", "keep_id", "keep_row", "copies", "texts", "start", "ids_crc32", "_window", "near", "holds", "term", "entity", "shingle", "license", "h", "w", "a.b", "with `tick`"]


def near(text: str, rng: random.Random, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, ties, repeated rows, empty and very long texts."""
    rng = random.Random(7)
    words = [f"{a}{b}" for a in "the of and tion er é ß".split() for b in "x y zo qu ing la".split()]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [(i, sentence(rng.randrange(1, 120)), "en", f"src{rng.randrange(25)}", 1) for i in range(60)]
    base = sentence(400)
    out += [(100 + i, near(base, rng, i % 3), "en", "src0", 1) for i in range(90)]
    out += [(200 + i, "Same Text here", "de", "src0", 1) for i in range(8)] + [(210, "same text HERE", None, None, None)]
    out += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, "no id at all", "en", "src2", 1), (None, None, None, None, None)]
    out += [(310, "É same", "fr", "src3", 6), (311, "é same", "fr", "src3", 6), (312, " \t\n", "fr", "other", 6)]
    out += [(320, "a\x1cb \x85 \xa0 c\x0bd", "fr", "zzz", 6), (321, sentence(30000), "en", "src4", 9), (322, ("Again and again it says the same thing now. " * 40), "en", "src4", 9)]
    return out + [(5, out[5][1], "en", out[5][3], 1)] * 2 + [(322, out[-1][1], "en", "src4", 9)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    def add(df):
        return df.select("*", *[F.lit("x").alias(c) for c in CLASHING if c not in df.columns])

    return add
