"""Files written whole or not at all, read by ranges, and documents whatever they hold."""

import hashlib
import json
import os
import struct
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodforge.operators import documents
from lodforge.operators.work import folder
from lodforge.sources import files, filetree, payloads, ranges


def local(path):
    return path.removeprefix("file://")


def tree(path):
    """Contents of all files under a folder, hidden ones too."""
    top = local(path)
    return {os.path.relpath(os.path.join(d, f), top): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(top) for f in names}


def table(spark, rows):
    return spark.createDataFrame([(u, bytearray(p) if p is not None else None) for u, p in rows], "uri string, payload binary")


def test_files_equal_rows_and_replace_what_was_there(spark):
    path = f"{folder(spark)}/tree"
    filetree.write_files(table(spark, [("old.bin", b"x")]), path)
    rows = [("a.bin", b"\0\1"), ("d/e/f.bin", os.urandom(100000)), ("empty", b""), ("null", None), ("d/./g.bin", b"g"), ("with space+%.x", b"s"), ("twice", b"same"), ("twice", b"same")]
    filetree.write_files(table(spark, rows).repartition(4), path)
    expected = {"a.bin": b"\0\1", "d/e/f.bin": rows[1][1], "empty": b"", "null": b"", "d/g.bin": b"g", "with space+%.x": b"s", "twice": b"same"}
    assert tree(path) == expected
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect()
    assert {os.path.relpath(local(r["path"]).replace("file:", ""), local(path)): bytes(r["content"]) for r in read} == {k: v for k, v in expected.items() if v}
    assert ranges.listing(spark, path, recursive=True).count() == len(expected)
    filetree.write_files(table(spark, [("more", b"m"), ("entry.json", b"{}")]), path, append=True, last="entry.json")
    assert tree(path) == {**expected, "more": b"m", "entry.json": b"{}"}
    filetree.write_files(table(spark, []), path)
    assert tree(path) == {} and os.listdir(os.path.dirname(local(path))) == ["tree"]


def test_the_entry_is_moved_after_all_others():
    class Files:
        moved = []
        create_dir = delete_dir = get_file_info = lambda *_, **__: filetree.fs.FileInfo("x", filetree.fs.FileType.NotFound)

        def move(self, source, target):
            self.moved.append(target)

    original, filetree.place = filetree.place, lambda path: (Files(), path)
    try:
        writer = filetree.FileTreeWriter({"path": "/t/tree", "last": "a"}, False, ["uri", "payload"])
        writer.commit([filetree.Staged("0", ["a", "b"]), None, filetree.Staged("1", ["c"])])
    finally:
        filetree.place = original
    assert Files.moved == ["/t/tree/b", "/t/tree/c", "/t/tree/a"]


@pytest.mark.parametrize("append", [False, True])
def test_a_task_that_dies_leaves_nothing_behind(spark, append):
    path = f"{folder(spark)}/tree"
    filetree.write_files(table(spark, [("kept", b"k")]), path)

    def dies(batches):
        for batch in batches:
            yield batch
            if (batch["uri"] == "f7").any():
                raise RuntimeError("executor lost")

    rows = table(spark, [(f"f{k}", b"x") for k in range(40)]).repartition(8).mapInPandas(dies, "uri string, payload binary")
    with pytest.raises(Exception, match="executor lost"):
        filetree.write_files(rows, path, append)
    assert tree(path) == {"kept": b"k"} and os.listdir(os.path.dirname(local(path))) == ["tree"]


@pytest.mark.parametrize("uri", ["../up", "/root", "a/../../b", "s3://x/y", "", "."])
def test_a_uri_outside_of_the_root_fails_the_write(spark, uri):
    path = f"{folder(spark)}/tree"
    with pytest.raises(Exception, match="not a path under the root"):
        filetree.write_files(table(spark, [("ok", b"1"), (uri, b"2")]), path)
    assert not os.path.exists(local(path)) and not os.listdir(os.path.dirname(local(path)))


def test_fingerprints_read_a_mib_of_a_file_of_three_gigabytes(spark):
    path = f"{folder(spark)}/big"
    os.makedirs(local(path))
    with open(f"{local(path)}/sparse.laz", "wb") as out:
        out.write(b"head")
        out.truncate(3 << 30)
    open(f"{local(path)}/empty", "wb").close()
    open(f"{local(path)}/small", "wb").write(b"abc")
    found = {r["name"]: r for r in files.fingerprints(spark, path).collect()}
    assert {n: (r["size"], r["bytes_read"]) for n, r in found.items()} == {"sparse.laz": (3 << 30, 1 << 20), "empty": (0, 0), "small": (3, 3)}
    assert found["sparse.laz"]["sha256"] == hashlib.sha256(b"head" + bytes((1 << 20) - 4)).hexdigest() and found["small"]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    assert len({r["dataset"] for r in found.values()}) == 1


def odd_payloads():
    sound = payloads.encode_payload(np.array([[0.0, 0, 0], [2, 4, 6]]), np.array([[1, 2, 3], [4, 5, 6]]))
    made = lambda head, body=b"": payloads.HEADER.pack(b"pnts", 1, 28 + len(head) + len(body), len(head), len(body), 0, 0) + head + body
    return [
        ("sound", sound), ("cut", sound[:-30]), ("short", b"pnts"), ("null", None), ("empty", b""), ("magic", b"xxxx" + sound[4:]), ("text", made(b'{"POINTS_LENGTH":"many","POSITION":{"byteOffset":0}}')), ("list", made(b"[1]")),
        ("nowhere", made(b'{"POINTS_LENGTH":1}', bytes(12))), ("offset", made(b'{"POINTS_LENGTH":1,"POSITION":{"byteOffset":-8}}', bytes(12))), ("huge", made(b'{"POINTS_LENGTH":4000000000,"POSITION":{"byteOffset":0}}', bytes(12))),
        ("center", made(b'{"POINTS_LENGTH":1,"POSITION":{"byteOffset":0},"RTC_CENTER":[1,"x"]}', bytes(12))), ("colours", made(b'{"POINTS_LENGTH":1,"POSITION":{"byteOffset":0},"RGB":{"byteOffset":12}}', bytes(12))), ("bytes", bytes(range(256))),
        ("length", struct.pack("<4s6I", b"pnts", 1, 4294967295, 4294967295, 0, 0, 0) + b"{}"),
    ]


def test_no_payload_can_kill_a_reader(spark):
    rows = table(spark, odd_payloads())
    heads = {r["uri"]: r for r in payloads.read_pnts_headers(rows).collect()}
    assert len(heads) == len(odd_payloads()) and heads["sound"]["points"] == 2 and heads["text"]["points"] is None and heads["center"]["center"] is None and heads["magic"]["magic"] == "xxxx"
    points = payloads.read_pnts_points(rows).collect()
    assert sorted((p["uri"], p["place"], p["x"], p["red"]) for p in points if p["uri"] != "colours") == [("center", 0, 0.0, None), ("sound", 0, 0.0, 1), ("sound", 1, 2.0, 4)]
    assert [p["red"] for p in points if p["uri"] == "colours"] == [None]
    path = f"{folder(spark)}/odd"
    filetree.write_files(rows, path)
    told = {r["path"].rsplit("/", 1)[1]: r for r in ranges.file_headers(ranges.listing(spark, path)).collect()}
    for uri, row in told.items():
        assert [row[k] for k in ("points", "center", "has_rgb")] == [heads[uri][k] for k in ("points", "center", "has_rgb")] and row["bytes_read"] <= row["size"]


BOX = [0.0] * 12


def tile(error=1.0, uri=None, children=None, **more):
    return {"boundingVolume": {"box": BOX}, "geometricError": error, **({"content": {"uri": uri}} if uri else {}), **({"children": children} if children else {}), **more}


def document(root):
    return json.dumps({"asset": {"version": "1.1"}, "root": root})


def test_documents_are_resolved_against_the_referring_one(spark):
    docs = [
        ("a/tileset.json", document(tile(9.0, children=[tile(8.0, "b/one.json?v=2"), tile(8.0, "../c.json"), tile(8.0, "gone.json"), tile(8.0, "../../up.json"), tile(8.0, "https://t/x.json"), tile(2.0, "big.json"), tile(1.0, "p.pnts")]))),
        ("a/b/one.json", document(tile(5.0, "../../d.json"))), ("c.json", document(tile(5.0, children=[tile(4.0, "d.json")]))), ("d.json", document(tile(3.0, "e.json"))),
        ("e.json", document(tile(3.0, "d.json"))), ("a/big.json", document(tile(5.0, children=[tile(1.0, "../cut.json"), tile(1.0, "../null.json"), tile(1.0, "../bare.json"), tile(1.0, "../odd.json")]))),
        ("cut.json", '{"root": {'), ("null.json", None), ("bare.json", '{"asset": {}}'), ("odd.json", '{"root": {"children": [3, {"content": "x", "geometricError": "big"}], "content": {"uri": 7}}}'), ("alone.json", document(tile())), ("c.json", document(tile(5.0, children=[tile(4.0, "d.json")]))),
    ]
    frame = spark.createDataFrame(docs, "uri string, json string")
    found = documents.resolve_documents(frame, "a/tileset.json")
    rows = [(r["doc"], r["steps"], r["target"], r["problem"]) for r in found.collect() if r["uri"] is not None or r["problem"]]
    assert sorted(rows, key=repr) == sorted([
        ("a/tileset.json", 0, "a/b/one.json", None), ("a/tileset.json", 0, "c.json", None), ("a/tileset.json", 0, "a/gone.json", "missing"), ("a/tileset.json", 0, None, "escapes"), ("a/tileset.json", 0, None, "remote"),
        ("a/tileset.json", 0, "a/big.json", "error grows"), ("a/tileset.json", 0, "a/p.pnts", None), ("a/b/one.json", 1, "d.json", None), ("c.json", 1, "d.json", None), ("d.json", 2, "e.json", "circle"), ("e.json", 3, "d.json", "circle"),
        ("a/big.json", 1, "cut.json", None), ("a/big.json", 1, "null.json", None), ("a/big.json", 1, "bare.json", None), ("a/big.json", 1, "odd.json", None), ("cut.json", 2, None, "broken"), ("null.json", 2, None, "null"), ("bare.json", 2, None, "no root"),
        ("odd.json", 2, None, "no error"), ("odd.json", 2, None, "no error"),
    ], key=repr)
    assert [r["uri"] for r in documents.unreferenced(frame, found).collect()] == ["alone.json"]
    assert [(r["doc"], r["problem"]) for r in documents.resolve_documents(frame.limit(0), "x.json").collect()] == [("x.json", "missing")]


def test_documents_of_odd_tiles(spark):
    rows = [("d", "", None), ("d", "0", ""), ("d", "01", "gone"), ("e", "x", "y"), ("e", "y", "x"), ("f", "", None), ("f", "", None), ("f", "1", "")]
    tiles = spark.createDataFrame([(d, p, q, 1.0, BOX, f"{d}{p}.pnts") for d, p, q in rows], "doc string, path string, parent string, error double, box array<double>, uri string")
    docs = {r["doc"]: r["json"] for r in payloads.tile_documents(tiles).collect()}
    assert docs["e"] is None and len(json.loads(docs["d"])["root"]["children"]) == 1 and json.loads(docs["f"])["root"]["children"][0]["content"]["uri"] == "f1.pnts"
    read = payloads.read_tile_documents(spark.createDataFrame(list(docs.items()), "doc string, json string"))
    assert {(r["doc"], r["problem"]) for r in read.where(F.col("problem").isNotNull()).collect()} == {("e", "null")}


def test_listing_scans_files_once_in_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    for k in range(100):
        (tmp_path / f"{k} %.txt").write_bytes(b"x" * (k % 3))
    monkeypatch.setattr(ranges, "SCANS", 1)
    limit = 8 * spark.sparkContext.defaultParallelism
    listed = ranges.listing(spark, f"file://{tmp_path}")
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and f"Repartition {limit}, false" in plan
    assert ranges.readable(listed) and sorted((r["path"].rsplit("/", 1)[1], r["size"], r["modified"] is None) for r in listed.collect()) == sorted((f"{k} %.txt", k % 3, k % 3 == 0) for k in range(100))


def test_variants_are_read_once_and_repeats_are_counted(spark):
    """As many rows as one side has more, over a block of repeats too, and each variant comes once in the plan."""
    one = spark.range(25_003).select(F.lit("many").alias("uri")).unionByName(spark.createDataFrame([("both",), ("both",), (None,)], "uri string"))
    two = spark.createDataFrame([("both",), ("many",), ("new",), ("new",), (None,), (None,)], "uri string")
    found = payloads.variant_parity(one, two)
    told = {(r["uri"], r["side"]): r["count"] for r in found.groupBy("uri", "side").count().collect()}
    assert told == {("many", "first"): 25_002, ("both", "first"): 1, ("new", "second"): 2}
    assert payloads.variant_parity(two, two).count() == 0
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Aggregate") == 1


def test_documents_are_built_once_a_variant(spark, small):
    from lodforge.plans import payloads as queries
    from lodforge.plans import tree as nodes

    plan = queries.variant_parity(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 2
    assert nodes._rolled(spark, small).inputFiles() == nodes._rolled(spark, small).inputFiles()


def test_names_of_files_do_not_meet_in_the_driver(spark, monkeypatch):
    """Messages of tasks hold few names, and the plan of the fingerprints none."""
    path = f"{folder(spark)}/tree"
    rows = [(f"{k % 7}/{k} %.txt", str(k).encode()) for k in range(6000)]
    writer = filetree.FileTreeWriter({"path": path}, True, ["uri", "payload"])
    monkeypatch.setattr(filetree.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: 0))
    message = writer.write(iter([*rows, *rows[:5], *rows[-5:]]))
    assert len(message.names) <= 1000
    writer.commit([message])
    monkeypatch.undo()
    assert tree(path) == dict(rows) and os.listdir(os.path.dirname(local(path))) == ["tree"]
    filetree.write_files(table(spark, rows).repartition(2).union(table(spark, rows[:5])), path)
    assert tree(path) == dict(rows)
    for name in ("_hidden", "1/.hidden"):
        open(f"{local(path)}/{name}", "wb").close()
    open(f"{local(path)}/1/empty", "wb").close()
    found = files.fingerprints(spark, path, recursive=True)
    assert "4999 %.txt" not in found._jdf.queryExecution().toString() and len(found.inputFiles()) < 200
    got = {r["name"]: (r["size"], r["sha256"]) for r in found.collect()}
    expected = {f"{k} %.txt": (len(str(k)), hashlib.sha256(str(k).encode()).hexdigest()) for k in range(6000)} | {"empty": (0, hashlib.sha256().hexdigest())}
    assert got == expected
    whole = json.dumps([{"name": n, "size": s, "sha256": h} for n, (s, h) in sorted(expected.items())], separators=(",", ":"))
    assert {r["dataset"] for r in found.select("dataset").distinct().collect()} == {hashlib.sha256(whole.encode()).hexdigest()}
    assert {r["name"] for r in files.fingerprints(spark, path).collect()} == set()
    with pytest.raises(FileNotFoundError):
        ranges.every_file(spark, f"{path}/none")
