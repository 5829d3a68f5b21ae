"""Answers to each request, and trailing edges, against a replay."""

import json
import random
import time
from collections import Counter
from datetime import datetime, timedelta

from lodestone.streaming import stateful


def put(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{number}").write_text("\n".join(map(json.dumps, rows)))
    (folder / f".{number}").rename(folder / f"{number:03d}.json")


def test_each_request_is_answered(spark, tmp_path):
    rng, limit = random.Random(1), 6
    start = datetime(2024, 1, 1, 10, 50)
    batches = [[{"key": rng.choice("ab"), "id": f"{n}-{i}", "at": (start + timedelta(minutes=rng.randrange(25))).isoformat()} for i in range(12)] for n in range(3)]
    found = {}  # by batch, as one that was not committed comes again
    for n, rows in enumerate(batches):
        put(tmp_path / "in", n, rows)
        source = spark.readStream.schema("key string, id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        answers = stateful.decisions(source, "key", "id", "at", "hour", limit)
        # a new run from the checkpoint for each batch: state outlives the query
        stream = answers.writeStream.foreachBatch(lambda df, n: found.update({n: df.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
        try:
            until = time.time() + 60
            while time.time() < until and sum(map(len, found.values())) < 12 * (n + 1) and stream.isActive:
                time.sleep(0.2)
            assert stream.exception() is None
        finally:
            stream.stop()
    want, counts = {}, Counter()
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            at = datetime.fromisoformat(r["at"])
            window = at.replace(minute=0)
            counts[r["key"], window] += 1
            n = counts[r["key"], window]
            want[r["id"]] = (r["key"], window, n, max(0, limit - n), n <= limit, window + timedelta(hours=1))
    found = [r for rows in found.values() for r in rows]
    assert {r.request: (r.key, r.window_start, r.requests, r.remaining, r.allowed, r.reset_at) for r in found} == want and len(found) == 36
    assert not all(r.allowed for r in found)


def test_trailing_edge_without_a_later_event(spark, tmp_path):
    put(tmp_path / "in", 0, [{"key": "a"}, {"key": "a"}, {"key": "b"}])
    source = spark.readStream.schema("key string").json(str(tmp_path / "in"))
    found = []
    stream = stateful.trailing_edges(source, "key", 3000).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and len(found) < 2:
            time.sleep(0.3)
        assert sorted((r.key, r.events) for r in found) == [("a", 2), ("b", 1)]
        put(tmp_path / "in", 1, [{"key": "a"}])
        while time.time() < until and len(found) < 3:
            time.sleep(0.3)
    finally:
        stream.stop()
    assert (found[2].key, found[2].events) == ("a", 1) and found[2].fired_at > max(r.fired_at for r in found[:2])
