"""Sources and sinks on small files, and the streaming twins on a directory of batches."""

import json

import pytest
from pyspark.sql import functions as F

from heddle.sources import files
from heddle.streaming.events import observations_to, stream_tumbling, tumbling


def test_compile_db(spark, tmp_path):
    units = [
        {"directory": "/p", "file": "a.c", "arguments": ["cc", "-O2", "-c", "-o", "a.o", "-MF", "a.d", "-MD", "src/a.c", "-Iinc"]},
        {"directory": "/p/", "file": "b.cc", "command": "c++ -std=c++17 b.cc"},
        {"directory": "/p", "file": "/q/c.c", "arguments": ["cc", "-o", "-o", "-Wall"]},
    ]
    (tmp_path / "db.json").write_text(json.dumps(units, indent=1))
    got = {r.file: r for r in files.compile_db(spark, str(tmp_path / "db.json")).collect()}
    assert got["/p/a.c"].args == ["-O2", "-Iinc"] and got["/p/a.c"].language == "c"
    assert got["/p/b.cc"].args == ["-std=c++17"] and got["/p/b.cc"].language == "cpp"
    assert got["/q/c.c"].args == ["-Wall"]


def test_scan_and_fallback(spark, tmp_path):
    root = tmp_path / "tests" / "a.b"
    for name in ("x.c", "sub/y.CXX", "z.hpp", "build/z.c", "sub/tests/t.c", "node_modules/n.c++", "note.txt", "m.m"):
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("int x;")
    got = sorted(r.path.rpartition("/")[2] for r in files.scan(spark, str(root)).collect())
    assert got == ["m.m", "n.c++", "x.c", "y.CXX"]
    (tmp_path / "empty.json").write_text("[]")
    assert {r.degraded for r in files.load(spark, str(root), str(tmp_path / "empty.json")).collect()} == {True}


def test_spans(spark):
    text = "\n".join(map(str, range(1, 501)))
    rows = spark.createDataFrame([(1, text, 2, 4), (2, text, 490, 501), (3, text, 1, 400), (4, None, 1, 1), (5, text, 0, 3)], "id int, t string, a int, z int")
    got = {r.id: r for r in files.code_range(rows, "t", "a", "z").collect()}
    assert (got[1].status, got[1].body) == ("ok", "2\n3\n4") and [got[k].status for k in (2, 4, 5)] == ["out_of_range", "missing", "out_of_range"]
    assert got[3].status == "partial" and got[3].next_line == 301 and got[3].body.endswith("\n300")
    span = rows.where("id = 3").select(files.read_span("t", F.lit(1), F.lit(400)).alias("s")).first().s
    assert span.count("\n") + 1 == 161


def test_sessions(spark, tmp_path):
    say = lambda *m: [{"role": r, "content": c} for r, c in m]
    head = {"schema_version": 1, "source_type": "public_synthetic", "source_ref": "r", "license": "MIT", "repository": "x", "revision": "abcdef1"}
    cases = [
        ({}, say(("user", " hi "), ("developer", "a"), ("reviewer", "b"), ("tool", "c")), None), ({"license": ""}, say(("user", "hi")), "no_license"), ({}, say(("system", "hi")), "role"),
        ({}, say(("user", "Password: x")), "secret"), ({"schema_version": 2}, say(("user", "hi")), "schema_version"), ({}, [], "no_messages"), ({}, say(("user", "  ")), "empty"), ({"source_type": "private"}, say(("user", "a")), "source_type"),
        ({}, [{"role": "user", "content": "a", "knowledge_role": "guess"}], "knowledge_role"), ({}, say(("user", "a" * 6001)), "too_long"),
    ]
    for k, (more, m, _) in enumerate(cases):
        (tmp_path / f"{k}.json").write_text(json.dumps({**head, "id": str(k), **more, "messages": m}))
    good, bad = files.sessions(spark, str(tmp_path))
    assert [(r.id, r.messages[0].content) for r in good.collect()] == [("0", "hi")]
    assert {r.id: r.reason for r in bad.collect()} == {str(k): why for k, (*_, why) in enumerate(cases) if why}


def test_activate_and_rollback(spark, tmp_path):
    root = str(tmp_path / "snap")
    for version, n in (("v1", 3), ("v2", 5)):
        files.write_snapshot({"t": spark.range(n)}, root, version)
    assert files.active(spark, root) == (None, None)
    files.activate(spark, root, "v1")
    held = files.pinned(spark, root)
    files.activate(spark, root, "v2")
    assert files.active(spark, root) == ("v2", "v1") and held("t").count() == 3 and files.pinned(spark, root)("t").count() == 5
    assert files.rollback(spark, root) == "v1" and files.active(spark, root)[0] == "v1"
    spark.range(9).write.mode("overwrite").parquet(f"{root}/v2/t")
    with pytest.raises(ValueError):
        files.activate(spark, root, "v2")



def test_cards(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"title": "t", "confidence": 0.5}\n{broken\n{"title": ""}\n')
    got = files.cards(spark, str(tmp_path / "c.jsonl")).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"imported": 1, "failed": 1, "skipped": 1}


def test_markdown_cards(spark, tmp_path):
    import hashlib

    body = "# Title\ntext\n"
    for name, digest in (("ok", hashlib.sha256(body.encode()).hexdigest()), ("bad", "0")):
        (tmp_path / f"{name}.md").write_text("---\n" + json.dumps({"id": name, "sha256": digest}) + "\n---\n" + body)
    got = {r.meta["id"]: r.intact for r in files.markdown_cards(spark, str(tmp_path)).collect()}
    assert got == {"ok": True, "bad": False}


def test_snapshot(spark, tmp_path):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    files.write_snapshot({"t": df, "u": df.limit(0)}, str(tmp_path), "v1")
    assert files.read_snapshot(spark, str(tmp_path), "v1", "t", verify=True).count() == 10
    df.where("id < 9").write.mode("overwrite").parquet(f"{tmp_path}/v1/t")
    with pytest.raises(ValueError):
        files.read_snapshot(spark, str(tmp_path), "v1", "t", verify=True)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream_tumbling(stream, late="100 days").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.start, r.event_type, r.n, round(r.total, 3)) for r in df.collect())
    assert key(spark.table("windows")) == key(tumbling(events))


def test_observation_stream(spark, tmp_path):
    obs = spark.createDataFrame([("t1", "a", "b", "certain"), ("t2", "a", "b", "certain")], "tu string, src string, dst string, confidence string")
    obs.write.parquet(str(tmp_path / "in"))
    q = observations_to(str(tmp_path / "out"), spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).drop("batch").exceptAll(obs).count() == 0
