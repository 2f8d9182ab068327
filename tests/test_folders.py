"""Folders as sources and sinks: labels with bad lines, uploads of all kinds in batch and stream, stages replaced by source."""

import os
import tempfile

import pytest

from chartlake.sources import folders, readers


def put(root, name, content):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "wb") as f:
        f.write(content)


def test_label_lines_keep_their_numbers(spark):
    root = tempfile.mkdtemp(prefix="spark-labels-")
    put(root, "train/labels/a.txt", b"1 0.5 0.25\n\n  \n2 nan-x 3\r\n7\n3.5 1 1\n4  1e2\t-3 ")
    put(root, "val/labels/b.txt", b"")
    put(root, "val/labels/c.md", b"1 1 1")
    got = sorted(map(tuple, readers.read_annotations(spark, root).collect()), key=lambda r: r[2])
    assert got == [("train", "a", 0, 1, [0.5, 0.25], None), ("train", "a", 3, None, None, "2 nan-x 3"), ("train", "a", 4, 7, [], None), ("train", "a", 5, None, None, "3.5 1 1"), ("train", "a", 6, 4, [100.0, -3.0], None)]


def test_uploads_of_all_kinds(spark):
    root = tempfile.mkdtemp(prefix="spark-uploads-")
    for name, content in {"a": b"xyz", "sub/empty": b"", "big": b"0" * 11, "edge": b"1" * 10, ".hidden": b"x", "_part": b"x"}.items():
        put(root, name, content)
    got = {r["file"].removeprefix(root + "/"): (r["length"], r["outcome"], r["content"] and bytes(r["content"])) for r in readers.read_uploads(spark, root, 10).collect()}
    assert got == {"a": (3, "ok", b"xyz"), "sub/empty": (0, "empty", None), "big": (11, "too_large", None), "edge": (10, "ok", b"1" * 10)}
    assert readers.read_uploads(spark, f"file://{root}", 10).count() == 4
    assert readers.read_uploads(spark, root + "/none").count() == 0
    assert [len(p.files) for p in folders.planned([("f", 0)] * 1500, 1)] == [512, 512, 476]
    assert [len(p.files) for p in folders.planned([("f", folders.TASK_BYTES)] * 3, folders.TASK_BYTES)] == [1, 1, 1]


def test_uploads_as_a_stream(spark):
    root, at = tempfile.mkdtemp(prefix="spark-uploads-"), tempfile.mkdtemp(prefix="spark-stream-")

    def drain():
        readers.stream_uploads(spark, root, 10).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(os.path.basename(r["file"]) for r in spark.read.schema("file string").parquet(f"{at}/out").collect())

    put(root, "a", b"1")
    put(root, "b", b"")
    assert drain() == ["a", "b"]
    put(root, "c", b"2" * 99)
    assert drain() == ["a", "b", "c"]
    assert drain() == ["a", "b", "c"]


def test_files_named_by_a_column(spark):
    root = tempfile.mkdtemp(prefix="spark-files-")
    rows = [(f"d{i % 3}/f{i % 7}", i, f"{i};") for i in range(200)] + [("none", 0, None)]
    for _ in range(2):  # a second run replaces the files of the first
        readers.write_files(spark.createDataFrame(rows, "file string, n int, content string").repartition(5), root, order=["n"])
    want = {}
    for f, _, c in rows:
        want[f] = want.get(f, "") + (c or "")
    found = {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs}
    assert found == want
    with pytest.raises(Exception, match="not a file name"):
        readers.write_files(spark.createDataFrame([("../x", "a")], "file string, content string"), root)


def test_stages_by_source(spark):
    path = tempfile.mkdtemp(prefix="spark-stage-") + "/s"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n int")
    readers.write_stage(df, path, "source")
    got = readers.write_stage(df.where("source = 'b'").selectExpr("source", "n + 10 AS n"), path, "source")
    assert sorted((r["source"], r["n"]) for r in got.collect()) == [("a", 1), ("b", 12)]
    assert readers.write_stage(df.where("n = 1"), path + "2").count() == 1


def test_lines_and_classes_from_files(spark):
    root = tempfile.mkdtemp(prefix="spark-in-")
    put(root, "lines/x.json", b'{"doc":"d","page":1,"line_no":0,"x0":1.5,"text":"t"}\n')
    row = readers.read_text_lines(spark, f"{root}/lines").head()
    assert (row["doc"], row["page"], row["x0"], row["text"], row["size"]) == ("d", 1, 1.5, "t", None)
    put(root, "good.json", b'[{"id":0,"name":"T11","fdi":11,"type":"tooth"},{"id":1,"name":"deep caries","type":"lesion"}]')
    assert [r["label"] for r in readers.read_class_map(spark, f"{root}/good.json").orderBy("id").collect()] == ["T11", "Deep Caries"]
    put(root, "bad.json", b'[{"id":0,"name":"a"},{"id":2,"name":"b"}]')
    with pytest.raises(ValueError, match="contiguous"):
        readers.read_class_map(spark, f"{root}/bad.json")


def test_named_files_are_written_from_whole_columns(spark):
    import pyarrow as pa

    batch = pa.record_batch({"file": ["a", "a", "b", "c", "c", "c", "a"], "content": ["x", None, None, "é", "", "z", "q"]})
    assert [(f, bytes(c)) for f, c in folders.runs(batch)] == [("a", b"x"), ("b", b""), ("c", "éz".encode()), ("a", b"q")]
    assert [(f, bytes(c)) for f, c in folders.runs(batch.slice(3, 3))] == [("c", "éz".encode())]
    assert [(f, bytes(c)) for f, c in folders.runs(pa.record_batch({"file": ["a"], "content": pa.array([None], pa.binary())}))] == [("a", b"")]
    root = tempfile.mkdtemp(prefix="spark-files-")
    rows = spark.range(25_000).selectExpr("concat('f', id div 12000) AS file", "id", "cast(concat(id, ';') AS binary) AS content")
    readers.write_files(rows, root, order=["id"])  # files of more rows than a batch
    for i in range(3):
        assert open(f"{root}/f{i}").read() == "".join(f"{k};" for k in range(12000 * i, min(12000 * (i + 1), 25_000)))


def test_label_lines_of_white_space_are_blank(spark):
    root = tempfile.mkdtemp(prefix="spark-labels-")
    put(root, "train/labels/a.txt", b"1 0.5\n\t\n \t \r\n2 1")
    assert sorted((r["line_no"], r["class_id"]) for r in readers.read_annotations(spark, root).collect()) == [(0, 1), (3, 2)]


def test_uploads_are_listed_by_tasks(spark, monkeypatch):
    """The driver lists no files; folders at any depth, loose files and long contents all come, each file once."""
    root = tempfile.mkdtemp(prefix="spark-uploads-")
    files = {f"{i % 5}/{'x/' * (i % 3)}f{i}": b"u" * (i % 12) for i in range(60)} | {f"loose{i}": b"v" for i in range(9)} | {".h/seen": b"w", "3/.hidden": b"n"}
    for name, content in files.items():
        put(root, name, content)
    os.makedirs(f"{root}/empty/folder")

    def never(*_):
        raise AssertionError("listed in the driver")

    monkeypatch.setattr(folders, "listed", never)
    for path in (root, f"file://{root}", f"file:{root}"):
        got = sorted((r["file"].removeprefix(root + "/"), r["length"], r["outcome"], r["content"] and bytes(r["content"])) for r in readers.read_uploads(spark, path, 10).collect())
        assert got == sorted((n, len(c), "empty" if not c else "too_large" if len(c) > 10 else "ok", c if 0 < len(c) <= 10 else None) for n, c in files.items() if n != "3/.hidden")
    batches = list(folders._batched(iter([("a", b"1" * (5 << 20)), ("b", b"2" * (5 << 20)), ("c", None)]), folders.pa.schema({"file": folders.pa.string(), "content": folders.pa.binary()})))
    assert [b.num_rows for b in batches] == [1, 2]
