"""Changes of a tree as a stream, without a collector."""

import os
import time

from lodestone.sources import tree
from lodestone.streaming import watch


def write(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_differences():
    before, after = {"a": [1_000_000, 1], "b": [2_000_000, 1], "c": [3_000_000, 1]}, {"b": [2_000_000, 1], "c": [3_000_000, 2], "d": [4_000_000, 0]}
    assert tree.differences(before, after) == [("delete", "a", 1), ("change", "c", 3), ("create", "d", 4)]
    assert tree.differences(after, after) == []


def test_listing(tmp_path):
    for name in ("src/a.ts", "node_modules/x.ts", "b.txt", "deep/er/c.py", "src/.git/d.ts"):
        write(tmp_path / name, "x", 5)
    assert tree.listing(str(tmp_path), watch.IGNORED, watch.WATCHED) == {"deep/er/c.py": [5_000_000_000, 1], "src/a.ts": [5_000_000_000, 1]}
    assert tree.listing(str(tmp_path / "nowhere"), watch.IGNORED, watch.WATCHED) == {}


def test_create_change_and_delete(spark, tmp_path):
    root, seen = tmp_path / "tree", []
    for name in ("src/a.ts", "src/b.ts", "src/c.ts"):
        write(root / name, "x", 5)
    handle = lambda rows, number: seen.append(sorted((r.type, r.path) for r in rows.collect()))
    stream = watch.watch(watch.tree_events(spark, str(root)), handle, str(tmp_path / "cp"), every="200 milliseconds")
    try:
        stream.processAllAvailable()
        write(root / "src/a.ts", "other", 6)
        write(root / "src/d.ts", "new", 6)
        (root / "src/b.ts").unlink()
        write(root / "dist/e.ts", "ignored", 6)
        until = time.time() + 60
        while time.time() < until and {x for batch in seen for x in batch} < {("change", "src/a.ts"), ("create", "src/d.ts"), ("delete", "src/b.ts")}:
            stream.processAllAvailable()
            time.sleep(0.2)
    finally:
        stream.stop()
    assert sorted(x for batch in seen for x in batch) == [("change", "src/a.ts"), ("create", "src/d.ts"), ("delete", "src/b.ts")]
    # from the checkpoint on, what happened meanwhile comes, once
    (root / "src/c.ts").unlink()
    seen.clear()
    stream = watch.watch(watch.tree_events(spark, str(root)), handle, str(tmp_path / "cp"), every="200 milliseconds")
    try:
        until = time.time() + 60
        while time.time() < until and not any(seen):
            stream.processAllAvailable()
            time.sleep(0.2)
    finally:
        stream.stop()
    assert [x for batch in seen for x in batch] == [("delete", "src/c.ts")]


def test_existing_files(spark, tmp_path):
    write(tmp_path / "t/a.ts", "x", 5)
    stream = watch.tree_events(spark, str(tmp_path / "t"), existing=True).writeStream.format("memory").queryName("there").start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("there").count():
            stream.processAllAvailable()
    finally:
        stream.stop()
    assert [tuple(r) for r in spark.table("there").collect()] == [("create", "a.ts", 5000)]
