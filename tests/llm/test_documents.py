"""Quality rules, exact and near dedup, mixing and packing against plain brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodestone.llm import mixing, packing, quality, simhash
from lodestone.llm.exact_dedup import exact_dedup, exact_groups
from lodestone.llm.simhash import near_dedup, near_groups

from .conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit), "base_failed": len(words) < 20 or 100 * len(hit) > 30 * len(words)}


def brute_cover(text, n):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(words[j]) for j in hit) / max(1, sum(map(len, words)))


def test_quality_matches_brute_force(docs, rows):
    got = quality.quality_rules(docs).collect()
    want = Counter((r[0], *brute_quality(r[1]).values()) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.n_words and r.n_words < 1000:
            for n, share in r.ngram_cover.items():
                assert share == pytest.approx(brute_cover(texts[r.doc_id] or "", n))


def test_coverage_makes_the_verdict():
    """Repeated n-grams and lines reject what passes the base; symbols alone do not."""
    rng = np.random.default_rng(0)
    plain = lambda n: " ".join(f"w{rng.integers(10**6)}" for _ in range(n))
    phrase, line, long = plain(6), plain(4), plain(10)
    cases = {
        plain(100): True,
        " ".join(f"{w}###" for w in plain(100).split()): True,
        " ".join(f"{phrase} {plain(1)}" for _ in range(10)): False,  # six of seven words in repeated 6-grams, no repeated window of eight
        "\n".join(f"{line}\n{plain(8)}" for _ in range(6)): False,  # 20 of 72 words in lines seen before, no n-gram limit is met
        f"{plain(30)} {long} {plain(27)} {long} {plain(3)}": False,  # 25 % of the words in repeated 10-grams
    }
    for text, kept in cases.items():
        m = quality.measure(text)
        assert not m["base_failed"] and m["kept"] == kept, (text, m)


def test_quality_survives_hash_collisions(monkeypatch):
    text = "a b c d e f g h i j " * 3 + "k l m n o p q r s t u v w x y z"
    want = quality.measure(text)
    monkeypatch.setattr(quality, "hash_of", lambda w: 0)
    assert quality.measure(text) == want and want["n_repeat_words"] == brute_quality(text)["n_repeat_words"]


def test_quality_filter_keeps_columns(docs, clashing):
    wide = clashing(docs)
    out = quality.quality_filter(wide)
    assert out.columns == wide.columns and {r["_q"] for r in out.collect()} == {"x"}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UP)].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda i: (i == keep, i is not None, i or 0))):
            out[(i, keep, len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def test_exact_dedup(docs, rows, clashing):
    wide = clashing(docs)
    got = exact_groups(wide).drop("row").collect()
    assert Counter(map(tuple, got)) == brute_exact(rows)
    kept = exact_dedup(wide)
    assert kept.columns == wide.columns and {r["_sha"] for r in kept.collect()} == {"x"}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.kept)


def test_exact_dedup_ties(spark):
    """Rows of one doc_id whose texts differ in case, or that differ in further columns: one stays, the same whatever the order."""
    some = [(1, t, "en", s, 1) for t in ("same text", "Same Text", "SAME TEXT") for s in ("a", "b", "c")] + [(None, "x", "en", "s", 1)] * 3
    seen = set()
    for parts in (1, 2, 5):
        kept = [tuple(r) for r in exact_dedup(spark.createDataFrame(some, SCHEMA).repartition(parts)).collect()]
        assert len(kept) == 2
        seen.update(r for r in kept if r[0] == 1)
    assert len(seen) == 1


def brute_fp(text):
    words = WORD.findall((text or "").translate(UP))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (1, 5)])
def test_near_groups(docs, rows, clashing, small, block):
    fp = [brute_fp(r[1]) for r in rows]
    root = brute_components(set(fp))
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = Counter((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fp, strict=True))
    assert Counter(map(tuple, near_groups(clashing(docs), small, block).collect())) == want


def test_near_dedup_keeps_one_of_each(docs, clashing):
    groups = near_groups(docs).collect()
    wide = clashing(docs)
    got = near_dedup(wide)
    assert got.columns == wide.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in groups if r.doc_id is None or r.doc_id == r.component_id)


@pytest.mark.parametrize(("small", "block"), [(64, 1024), (0, 7)])
def test_anchors_lose_no_link(spark, small, block):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 20, dtype=np.uint64)
    fps = set(map(int, seeds))
    for s in map(int, seeds):
        for _ in range(15):
            s ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(s)
    rows = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), small, block).collect()
    unsigned = lambda x: x & (2**64 - 1)
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for e in edges:
        parent[find(unsigned(e.a))] = find(unsigned(e.b))
    want, classes = brute_components(fps), {}
    for f in fps:
        assert classes.setdefault(want[f], find(f)) == find(f)
    assert len(set(classes.values())) == len(classes)


def test_frame_is_pfair():
    weights = mixing.WEIGHTS
    size, slots = sum(weights.values()), mixing.frame(weights)
    done = Counter()
    for t, x in enumerate(slots):
        assert x["release"] <= t < x["deadline"] and x["job"] == done[x["class"]]
        done[x["class"]] += 1
        assert all(abs(done[s] * size - (t + 1) * k) < size for s, k in weights.items())
    assert done == Counter(weights)


def test_mixing(docs, rows, clashing):
    wide = clashing(docs)
    out = mixing.mixed(wide, {"src0": 2, "src4": 1, "other": 3}, block_docs=2, buckets=16).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert len({r.mix_pos for r in out}) == len(out)
    by = defaultdict(set)
    for r in out:
        assert r["class"] == (r.source if r.source in ("src0", "src4") else "other")
        assert r.release <= r.slot < r.deadline and r.mix_pos // 2 == r.slot
        by[r["class"]].add(r.block)
    assert all(b == set(range(len(b))) for b in by.values())
    same = mixing.mix(wide)
    assert same.columns == wide.columns and same.count() == len(rows)
    known = {r[0]: r for r in rows}
    assert all(r.source == known[r.doc_id][3] and r["_rank"] == "x" and r["a.b"] == "x" for r in out if r.doc_id not in (None, 5, 322))


def test_mixing_rows_without_ids(spark):
    """Null ids are ranked in parts, and every row has the rank that sorting by key gives, but for ties."""
    some = [(i if i % 3 else None, f"t{i % 50}", "en", "src0", 1) for i in range(900)]
    out = mixing.mixed(spark.createDataFrame(some, SCHEMA).repartition(7), {"src0": 1, "other": 1}, block_docs=1, buckets=2).collect()
    ranks = sorted((r.mix_pos, hashlib.md5(str("" if r.doc_id is None else r.doc_id).encode()).hexdigest()) for r in out)
    assert len(out) == 900 and [k for _, k in ranks] == sorted(k for _, k in ranks) and len({p for p, _ in ranks}) == 900


def test_packing(docs, rows, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.packed(clashing(docs), buckets=4).collect()
    want = Counter()
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            cut = ids[k : k + 4096]
            want[(r[0], k // 4096, k, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in out) // 4096)


@pytest.mark.parametrize("text", ["a<|endoftext|>b <|startoftext|>", "A<|EndOfText|>B <|ENDOFTEXT|>", "Word. word,. 'x'. a.b. don't!'s é. É. ß, ñ!' x?y ?!", "a\x0bb\x0c.\x1f c", "It's  the\tα\x85b c ΑΣ. Σ é ́x", "x" * 5000, "12 345 ##!!", "\r\n \n\n", "İstanbul ﬁ 　 漢字 🙂👍🏽 a​b"])
def test_ids_word_by_word(text):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    ids, begins = packing.Ids(path).batch(pa.array([None, text, "", text]).slice(1))
    want = [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, packing.END]
    assert ids.tolist() == [*want, packing.END, *want] and begins.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_ids_of_forgotten_words(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBERED", 20)
    monkeypatch.setattr(packing, "KEPT", 7)
    path, rng = packing.default_tokenizer(), np.random.default_rng(0)
    ids, tokenizer = packing.Ids(path), Tokenizer.from_file(path)
    alphabet = np.array(list("ab'é \t\n\r\x0b\x1cÉ\x85\xa0\u0301İ#12!<|>sS.,"))
    for _ in range(60):
        texts = ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(40)]
        got, begins = ids.batch(pa.array(texts))
        assert [got[i:j].tolist() for i, j in zip(begins[:-1], begins[1:], strict=True)] == [[*e.ids, packing.END] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(ids.parts) <= 20 + 600 and len(ids.sizes) == len(ids.parts) + packing.FIRST


def test_patterns_use_every_piece_once():
    rng = np.random.default_rng(1)
    for capacity, n in ((64, 500), (64, 3), (10, 40), (4096, 3000)):
        counts = Counter(map(int, rng.integers(1, capacity + 1, n)))
        plan = packing.patterns(counts, capacity)
        used = Counter()
        for k, lengths in plan:
            assert sum(lengths) <= capacity
            for x in lengths:
                used[x] += k
        assert used == counts


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (quality.quality_rules, exact_groups, exact_dedup, near_groups, near_dedup, mixing.mixed, mixing.mix, packing.packed):
        assert f(none).count() == 0
