"""The library's own sources: round trips, parallel parts, restarts."""

from __future__ import annotations

import json
import sqlite3
import threading

import pytest

from duskline.sources import feeds


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "traffic.db")
    rows = [(i // 3 if i % 10 else None, f"10.0.0.{i % 9}", i * 1.5, bytes([i % 256]), None if i % 7 == 0 else i) for i in range(1000)]
    rows += [(5, "hot", 0.0, b"", 1)] * 400
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "network traffic" (id INTEGER, "source ip" TEXT, bytes REAL, raw BLOB, n BIGINT)')
        con.executemany('INSERT INTO "network traffic" VALUES (?, ?, ?, ?, ?)', rows)
        con.execute("CREATE TABLE blank (id INTEGER)")
    return path, rows


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("key", [None, "id", "source ip"])
def test_database_round_trip(spark, database, key):
    path, rows = database
    df = feeds.read_database(spark, path, "network traffic", key, 6)
    assert df.dtypes == [("id", "bigint"), ("source ip", "string"), ("bytes", "double"), ("raw", "binary"), ("n", "bigint")]
    got = [(r[0], r[1], r[2], bytes(r[3]), r[4]) for r in df.collect()]
    assert ordered(got) == ordered(rows)


def test_database_parts_are_even_and_keep_equal_keys_together(spark, database):
    path, rows = database
    reader = feeds.DatabaseTable({"path": path, "table": "network traffic", "key": "id", "partitions": "6"}).reader(feeds_schema(spark))
    parts = reader.partitions()
    sizes = [sum(b.num_rows for b in reader.read(p)) for p in parts]
    assert sum(sizes) == len(rows) and 4 <= len(parts) <= 6
    hot = sum(r[0] == 5 for r in rows)
    assert max(sizes) <= hot + 2 * len(rows) // 6
    assert feeds.read_database(spark, path, "blank", "id").count() == 0


def feeds_schema(spark):
    return spark.createDataFrame([], "id long, `source ip` string, bytes double, raw binary, n long").schema


def append(folder, name, rows, end="\n"):
    with open(folder / name, "a") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows[:-1]) + json.dumps(rows[-1]) + end)


def run(spark, folder, out, start="earliest"):
    stream = feeds.read_segments(spark, str(folder), "id long, text string", start)
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(out) + "-state").trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    q.stop()
    return sorted(r.id for r in spark.read.schema("id long, text string, segment string, position long").parquet(str(out)).collect())


def test_segments_restart_without_loss_or_repeats(spark, tmp_path):
    folder, out = tmp_path / "log", tmp_path / "out"
    folder.mkdir()
    assert feeds.SegmentReader(str(folder), "earliest").latestOffset() == {"segment": "", "byte": 0}
    append(folder, "0001.jsonl", [{"id": i, "text": "é" * i} for i in range(5)])
    assert run(spark, folder, out) == list(range(5))
    append(folder, "0001.jsonl", [{"id": 5}, {"id": 6}])
    append(folder, "0002.jsonl", [{"id": 7}, {"id": 8}], end="")  # the last line is not finished
    assert run(spark, folder, out) == list(range(8))
    with open(folder / "0002.jsonl", "a") as f:
        f.write("\n\n")
    append(folder, "0003.jsonl", [{"id": 9}])
    assert run(spark, folder, out) == list(range(10))
    assert run(spark, folder, out) == list(range(10))


def test_segments_slices_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "SLICE", 7)
    append(tmp_path, "a.jsonl", [{"id": i, "t": "x" * (i % 11)} for i in range(40)])
    reader = feeds.SegmentReader(str(tmp_path), "earliest")
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    got = [json.loads(v)["id"] for p in parts for _, _, v in reader.read(p)]
    assert got == list(range(40)) and len(parts) > 40
    assert feeds.SegmentReader(str(tmp_path), "latest").initialOffset() == reader.latestOffset()


def test_writers_may_go_on_while_a_stream_reads(spark, tmp_path):
    folder, out = tmp_path / "log", tmp_path / "out"
    folder.mkdir()
    append(folder, "0.jsonl", [{"id": 0}])

    def write():
        for i in range(1, 60):
            append(folder, f"{i // 20}.jsonl", [{"id": i}])

    t = threading.Thread(target=write)
    t.start()
    run(spark, folder, out)
    t.join()
    assert run(spark, folder, out) == list(range(60))
