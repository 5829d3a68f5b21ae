"""The pipeline against brute force, stage by stage and as a whole."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from lodestone.llm import mixing, packing, quality

from .conftest import SCHEMA
from .test_documents import UP, brute_components, brute_fp


def brute(rows):
    """Rows that the first three stages keep: good texts, the largest id of equal ones, the smallest of near ones."""
    kept = [r for r in rows if quality.measure(r[1])["kept"]]
    by_text = {}
    for r in kept:
        key = (r[1] or "").translate(UP)
        if key not in by_text or (r[0] is not None and (by_text[key][0] is None or r[0] > by_text[key][0])):
            by_text[key] = r
    kept = list(by_text.values())
    fps = [brute_fp(r[1]) for r in kept]
    root, least = brute_components(set(fps)), {}
    for r, f in zip(kept, fps, strict=True):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    stay = {r[0] for r, f in zip(kept, fps, strict=True) if r[0] is not None and least[root[f]] == r[0]}
    return [r for r in kept if r[0] is None or r[0] in stay]


def test_run(spark, rows, docs, tmp_path):
    from tokenizers import Tokenizer

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for r in brute(rows):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 1]
        for start in range(0, len(ids), 4096):
            cut = ids[start : start + 4096]
            want[(r[0], start // 4096, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_stages_keep_columns(spark, docs, tmp_path, clashing):
    now = docs = clashing(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "mixing", "packing"]


def test_empty(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sequences_follow_the_mix(spark, tmp_path):
    """While a source has rows, each prefix of the sequences holds its weight of the texts, by the mix's own positions."""
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(rng.randrange(20, 400))), "en", f"src{i % 20}", 1) for i in range(4000)], SCHEMA).repartition(5)
    at = {r.doc_id: (r.mix_pos, r.source) for r in mixing.mixed(docs).collect()}
    last = dict(corpus_pipeline.STAGES)["packing"]
    got = sorted(last(spark, docs, str(tmp_path)).collect(), key=lambda r: r.sequence_id)
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(list(at))
    ranks = {d: k for k, d in enumerate(sorted(at, key=at.get))}
    width = 2 * packing.WINDOW_PIECES
    assert all(abs(ranks[r.doc_id] - k) < width for k, r in enumerate(got))
    head = [at[r.doc_id][1] for r in got[: packing.WINDOW_PIECES // 2]]
    assert 0.15 < head.count("src0") / len(head) < 0.25  # weight 0.20, but 0.05 of the rows
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 4096 and set(used) == set(range(len(used)))
    assert len(used) <= -(-sum(used.values()) // 4096) + len(ranks) // packing.WINDOW_PIECES
