"""Sinks, change logs and streams."""

import json
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.state import Store
from sluice.sinks.base import LoadId, SinkError, safe
from sluice.sinks.files import BatchFolders, event_log
from sluice.sinks.keyed import Conflict, KeyedTable, Routed
from sluice.sources import changes, cursor, readers
from sluice.sources.slots import Slot
from sluice.streaming import windows
from sluice.streaming.changes import ChangeRun, lag_tier

CDC = "id long, name string, `_cdc.op` string, `_cdc.lsn` string, `_cdc.commit_ts` timestamp, `_cdc.txid` long, `_cdc.seq` long"


def log(spark, *rows, ddl=CDC):
    return spark.createDataFrame([(*r[1:], r[0], "0/1", None, 1, i) for i, r in enumerate(rows)], ddl)


def load(n, stream="", run="r"):
    return LoadId("t", "p", run, n, stream)


def state(table):
    return {r["id"]: r["name"] for r in table.read().collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "table"), ("id",), buckets=3)


def test_batch_folders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    sink = BatchFolders(str(tmp_path))
    for _ in range(2):
        out = sink.load(load(3), rows)
    assert out.rows == 2 and out.path.endswith("t/p/r/batch=00003") and spark.read.parquet(out.path).count() == 2
    empty = sink.load(load(4, "s"), rows.where("false"))
    assert empty.rows == 0 and spark.read.parquet(empty.path).columns == ["id", "name"]
    assert "/cdc/" in event_log(str(tmp_path)).path(load(1))
    for bad in ("..", "a/b", "a\\b", ""):
        with pytest.raises(SinkError):
            safe(bad)


def test_append_and_same_load(spark, tmp_path):
    plain = KeyedTable(spark, str(tmp_path / "plain"))
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string")
    assert plain.load(load(0), rows).rows == 3 and plain.load(load(0), rows).rows == 0
    plain.load(load(1), rows)
    assert plain.read().count() == 6 and plain.read(1).count() == 3
    assert plain.read().where("name IS NULL").count() == 2


def test_upsert(spark, table):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    table.load(load(0), rows)
    table.load(load(1), rows.withColumn("name", F.upper("name")).union(spark.createDataFrame([(3, "c")], "id long, name string")))
    assert state(table) == {1: "A", 2: "B", 3: "c"}
    with pytest.raises(SinkError):
        table.load(load(2), rows.drop("id"))


def test_changes_apply(spark, table):
    table.load(load(0), log(spark, ("i", 1, "a"), ("i", 2, "b")))
    table.load(load(1), log(spark, ("u", 1, "a-prime"), ("d", 2, None), ("i", 3, "c"), ("c", None, None), ("h", None, None), ("t", None, None)))
    assert state(table) == {1: "a-prime", 3: "c"} and table.read().columns == ["id", "name"]
    with pytest.raises(Exception, match="unknown op"):
        table.load(load(2), log(spark, ("x", 1, "a")))


def test_changes_converge_in_any_split(spark, tmp_path):
    rows = [("s", 1, "snap-1"), ("s", 2, "snap-2"), ("u", 1, "stream-1"), ("i", 3, "stream-3"), ("d", 2, None), ("i", 2, "back")]
    whole = log(spark, *rows)
    for n, cuts in enumerate(([6], [1, 6], [2, 3, 5, 6])):
        t = KeyedTable(spark, str(tmp_path / f"t{n}"), ("id",), 2)
        low = 0
        for i, high in enumerate(cuts):
            t.load(load(i), whole.where((changes.meta("seq") >= low) & (changes.meta("seq") < high)))
            low = high
        assert state(t) == {1: "stream-1", 2: "back", 3: "stream-3"}
    assert {r["id"] for r in changes.current_state(whole, ["id"]).collect()} == {1, 2, 3}


def test_deletes_as_marks(spark, tmp_path):
    rows = log(spark, ("i", 1, "a"), ("i", 2, "b"), ("d", 2, None)).withColumn("_cdc.commit_ts", F.lit("2026-01-01").cast("timestamp"))
    marked = KeyedTable(spark, str(tmp_path / "m"), ("id",), 2, deletes="column")
    marked.load(load(0), rows)
    assert {(r["id"], r["_deleted_at"] is None) for r in marked.read().collect()} == {(1, True), (2, False)}
    side = KeyedTable(spark, str(tmp_path / "s"), ("id",), 2, deletes="side_table")
    side.load(load(0), rows)
    assert {r["id"] for r in side.read().collect()} == {1} and {r["id"] for r in KeyedTable(spark, str(tmp_path / "s_deletes"), ("id",), 2).read().collect()} == {2}


def test_truncate(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ("id",), 2, apply_truncate=True)
    t.load(load(0), log(spark, ("i", 1, "a")))
    t.load(load(1), log(spark, ("i", 2, "b"), ("t", None, None), ("i", 3, "c")))
    assert state(t) == {3: "c"}


def test_unchanged_cells_keep_their_value(spark, table):
    table.load(load(0), log(spark, ("i", 1, "stored"), ("i", 2, "old")))
    raw = log(spark, ("u", 1, changes.UNCHANGED), ("u", 2, "new"), ("u", 2, changes.UNCHANGED)).withColumn("id", F.col("id").cast("string"))
    table.load(load(1), changes.typed(raw, T.StructType.fromDDL("id bigint, name string")))
    assert state(table) == {1: "stored", 2: "new"}


def test_evolution_at_the_destination(spark, table):
    table.load(load(0), log(spark, ("i", 1, "a")))
    wide = log(spark, ("c", None, None, None), ("i", 2, "b", 1.5), ddl=CDC.replace("name string", "name string, score double"))
    table.load(load(1), wide)
    assert {(r["id"], r["score"]) for r in table.read().collect()} == {(1, None), (2, 1.5)}
    before = table.versions()
    with pytest.raises(SinkError):
        table.load(load(2), log(spark, ("c", None, None), ("i", 3, "x")))
    assert table.versions() == before


def test_routing(spark, tmp_path):
    routed = Routed(spark, str(tmp_path), keys=("id",), buckets=2)
    rows = spark.createDataFrame([(1, "a", "users"), (1, "b", "public.orders")], "id long, name string, _stream string")
    routed.load_streams(load(0), rows)
    assert state(routed.of("users")) == {1: "a"} and state(routed.of("public.orders")) == {1: "b"}
    for bad in ('a"b', "", "a\x00"):
        with pytest.raises(SinkError):
            routed.of(bad)


def test_versions_compaction_conflict(spark, table):
    rows = spark.createDataFrame([(i, "a") for i in range(20)], "id long, name string")
    table.load(load(0), rows)
    table.load(load(1), rows.where("id = 3").withColumn("name", F.lit("b")))
    table.compact()
    table.rebucket(5)
    assert state(table)[3] == "b" and len(state(table)) == 20 and state_at(table, 1)[3] == "a"
    table.expire(1)
    assert len(table.versions()) == 1 and len(state(table)) == 20
    m = table.manifest()
    stale = type(m)(m.version - 1, m.schema, m.keys, m.buckets, m.folders, m.loads)
    with pytest.raises(Conflict):
        table._commit(stale, m.schema, m.folders, None, 0)


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path):
    """No task sorts a whole bucket, on the first load and on a merge with what the bucket holds."""
    t, share = KeyedTable(spark, str(tmp_path / "t"), ("id",), 2), "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(share)
    spark.conf.set(share, "64k")
    try:
        for n, rows in enumerate((spark.range(200_000), spark.range(100_000, 300_000))):
            t.load(load(n), rows.repartition(8).select("id", F.lit(n).alias("name")))
            for folder in sum(t.manifest().folders.values(), []):
                files = [r["count"] for r in spark.read.parquet(f"{t.path}/{folder}").groupBy(F.input_file_name()).count().collect()]
                assert len(files) > 1 and max(files) < 0.6 * sum(files)
    finally:
        spark.conf.set(share, before)
    held = t.read()
    assert held.count() == held.select("id").distinct().count() == 300_000
    assert held.where((F.col("id") >= 100_000) != (F.col("name") == 1)).count() == 0


def state_at(table, version):
    return {r["id"]: r["name"] for r in table.read(version).collect()}


# ---- the binary log ----


def text(s):
    return s.encode() + b"\0"


def relation(id_=1, columns=(("id", 20, 1), ("name", 25, 0))):
    return b"R" + struct.pack(">I", id_) + text("public") + text("items") + b"f" + struct.pack(">H", len(columns)) + b"".join(bytes([k]) + text(n) + struct.pack(">Ii", o, -1) for n, o, k in columns)


def cells(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">I", len(v)) + v.encode()
    return out


def begin(xid=7):
    return b"B" + struct.pack(">QqI", 100, 0, xid)


def commit(lsn=100, at=0):
    return b"C\0" + struct.pack(">QQq", lsn, lsn, at)


def test_decoder():
    sent = [begin(), relation(), b"I" + struct.pack(">I", 1) + b"N" + cells("1", "a"), commit(5, 1_000_000), b"M...", begin(8), b"U" + struct.pack(">I", 1) + b"N" + cells("1", ...), b"D" + struct.pack(">I", 1) + b"O" + cells("1", "a"), b"T" + struct.pack(">IBI", 1, 0, 1), commit(6), begin(9), b"I" + struct.pack(">I", 1) + b"N" + cells("2", None)]
    got = list(changes.decode(iter(sent)))
    assert [(e.op, e.lsn, e.txid) for e in got] == [("i", 5, 7), ("u", 6, 8), ("d", 6, 8), ("t", 6, 8)]
    assert got[0].commit_us == 1_000_000 + changes.EPOCH and got[1].values["name"] == changes.UNCHANGED and got[2].values == {"id": "1", "name": None}
    for bad in ([b"Z"], [b""], [b"I" + struct.pack(">I", 9) + b"N"], [begin(), relation(), b"I" + struct.pack(">I", 1) + b"N" + struct.pack(">H", 1) + b"x"], [b"B\0"]):
        with pytest.raises(changes.DecodeError):
            list(changes.decode(iter(bad)))


def test_binary_log_to_table(spark, table):
    one = [begin(), relation(), b"I" + struct.pack(">I", 1) + b"N" + cells("1", "a"), b"I" + struct.pack(">I", 1) + b"N" + cells("2", "b"), commit(5)]
    two = [relation(), begin(8), b"U" + struct.pack(">I", 1) + b"N" + cells("1", ...), b"D" + struct.pack(">I", 1) + b"K" + cells("2", None), commit(6)]
    frame = spark.createDataFrame([(s, s * 100 + i, m) for s, ms in enumerate((one, two)) for i, m in enumerate(ms)], "segment int, seq long, data binary")
    rows = changes.decode_log(frame, "items", T.StructType.fromDDL("id bigint, name string"))
    table.load(load(0), rows)
    assert state(table) == {1: "a"}


def test_whole_transactions(spark):
    rows = log(spark, *[("i", i, "x") for i in range(6)]).withColumn("_cdc.txid", (changes.meta("seq") / 4).cast("long"))
    assert changes.whole_transactions(rows, 2).count() == 4 and changes.whole_transactions(rows, 5).count() == 6


# ---- sources ----


def test_cursor_scans(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, None)], "id long, at long")
    scan = cursor.CursorScan("at", ("id",))
    assert scan.page(rows, None, 1).count() == 2 and scan.position(rows).value == "20"
    from sluice.plans.state import Cursor

    assert {r["id"] for r in scan.after(rows, Cursor("int64", "10")).collect()} == {1, 2, 3}
    assert {r["id"] for r in cursor.CursorScan("at", ("id",), resume="strict").after(rows, Cursor("int64", "10")).collect()} == {3}
    for bad in (cursor.CursorScan("nobody"), cursor.CursorScan("at"), cursor.CursorScan("at", ("id",), cursor_class="unreliable"), cursor.CursorScan("at", ("id",), allow_nullable=False)):
        with pytest.raises(cursor.CursorError):
            bad.check(rows.schema)
    with pytest.raises(cursor.CursorError):
        scan.after(rows, Cursor("lsn", "0/1"))
    negative = spark.createDataFrame([(-5,), (0,), (7,)], "id long")
    assert [r[0] for r in cursor.snapshot_chunk(negative, "id", None, 2).collect()] == [-5, 0]
    parts = cursor.ranges(spark.range(100).toDF("id"), "id", 4)
    assert parts[0][0] == 0 and parts[-1][1] == 99 and all(a[1] + 1 == b[0] for a, b in zip(parts, parts[1:]))
    keyed = cursor.synthetic_key(spark.createDataFrame([(None, "x"), ("", "x")], "a string, b string"), ["a", "b"])
    assert keyed.select("_key").distinct().count() == 2
    assert cursor.composite(rows, ["at", "id"], [10, 1]).count() == 2


@pytest.mark.parametrize("kind", ["long", "int", "date", "timestamp", "timestamp_ntz"])
def test_bound_of_a_large_page(spark, monkeypatch, kind):
    """Counts of ranges find the bound that a top-k finds, with ties, values below zero and far ends, and without one."""
    number = {"long": "n", "int": "CAST(n % 2000000011 AS int)", "date": "date_from_unix_date(CAST(n % 40000 AS int))"}.get(kind, f"CAST(timestamp_micros(n % 4000000000000007) AS {kind})")
    ends = "UNION ALL VALUES (-9223372036854775807L), (9223372036854775807L), (9223372036854775806L)"
    rows = spark.sql(f"SELECT {number} AS at FROM (SELECT (id - 300) * (id - 300) * (id - 300) * IF(id % 3 = 0, 1, 977) DIV 50 AS n FROM range(600) UNION ALL SELECT 5L FROM range(200) {ends})").cache()
    ordered = sorted(r["at"] for r in rows.collect())
    scan = cursor.CursorScan("at", ("at",))
    monkeypatch.setattr(cursor, "TOP", 0)
    for n in (1, 401, 803, 804):
        want = [v for v in ordered if n > len(ordered) or v <= ordered[n - 1]]
        page = scan.page(rows, None, n)
        assert sorted(r["at"] for r in page.collect()) == want
    assert scan.page(rows.limit(0), None, 1).count() == 0
    rows.unpersist()


def test_large_pages_take_no_top_k(spark, monkeypatch):
    """Beyond ``TOP`` no task holds a page of rows."""
    monkeypatch.setattr(cursor, "RANGES", 10)
    seen, order = [], type(spark.range(1)).orderBy
    monkeypatch.setattr(type(spark.range(1)), "orderBy", lambda self, *a, **k: seen.append(a) or order(self, *a, **k))
    assert cursor.CursorScan("id", ("id",)).page(spark.range(50_000), None, 20_000).count() == 20_000 and not seen
    assert cursor.CursorScan("id", ("id",)).page(spark.range(50_000), None, 200).count() == 200 and seen


def test_readers(spark, tmp_path):
    assert readers.greeting(spark).count() == 3
    assert [tuple(r) for r in readers.csv_text(spark, "a,b\n1,x\n2,y\n", after=0).collect()] == [(1, "2", "y")]
    assert readers.csv_text(spark, "1,x\n", header=False).columns == ["_row_index", "column_0", "column_1"]
    with pytest.raises(readers.SourceError):
        readers.csv_text(spark, "a,b\n1\n")
    calls = []

    def fetch(after, limit):
        calls.append(after)
        if len(calls) == 1:
            return 429, ""
        page = {None: (["1", "2"], True), "2": (["3"], False)}[after]
        return 200, json.dumps({"data": [{"id": i, "email": None, "name": "n", "created": 1} for i in page[0]], "has_more": page[1]})

    assert [r[0] for r in readers.pages(fetch, 2)] == ["1", "2", "3"]
    with pytest.raises(readers.SourceError):
        list(readers.pages(lambda a, n: (500, "")))
    (tmp_path / "0.json").write_text(json.dumps({"_after": None, "data": [{"id": "1", "created": 5}], "has_more": True}))
    (tmp_path / "1.json").write_text(json.dumps({"_after": "1", "data": [{"id": "2", "created": 6}], "has_more": False}))
    spark.dataSource.register(readers.PageSource)
    assert [r["id"] for r in spark.read.format("sluice_pages").option("pages", str(tmp_path)).load().collect()] == ["1", "2"]
    assert readers.connector("hello@0.1.0")[0] == "bounded" and readers.connector("wasm-cdc:x")[0] == "continuous"
    with pytest.raises(readers.SourceError):
        readers.connector("nobody")
    rows = readers.greeting(spark)
    readers.smoke(rows, rows.schema, 3)
    with pytest.raises(readers.SourceError):
        readers.smoke(rows, rows.schema, 2)


# ---- streams ----


def test_snapshot_then_stream(spark, tmp_path, table):
    source = spark.createDataFrame([(-1, "a"), (1, "b"), (2, "c")], "id long, name string")
    change = ChangeRun(spark, Store(spark, str(tmp_path)), table, "t", "p", "items", "id")
    assert change.snapshot(source, "0/5", rows=2) == 2 and state(table) == {-1: "a", 1: "b", 2: "c"}
    folder = tmp_path / "log"
    folder.mkdir()
    events = [("u", 1, "B"), ("d", 2, None), ("i", 3, "d")]
    for i, (op, id_, name) in enumerate(events):
        (folder / f"{i}.json").write_text(json.dumps({"op": op, "lsn": "0/6", "ts_us": 0, "txid": i, "seq": i, "row": {"id": id_, "name": name}}) + "\n")
    schema = T.StructType.fromDDL("id bigint, name string")
    boom = []

    def crash(batch, number):
        if number == 1 and not boom:
            boom.append(1)
            raise RuntimeError("crash")

    where = str(tmp_path / "checkpoint")
    with pytest.raises(Exception, match="crash"):
        change.follow(str(folder), schema, where, after=crash).awaitTermination()
    (folder / "3.json").write_text(json.dumps({"op": "h", "lsn": "0/A", "ts_us": 0, "txid": 9, "seq": 9, "row": None}) + "\n")
    change.slot = Slot(Store(spark, str(tmp_path)), "items")
    change.slot.ensure(("items",), "0/5")
    change.follow(str(folder), schema, where).awaitTermination()
    assert change.slot.confirmed() == "0/A"  # a heartbeat's position counts
    assert state(table) == {-1: "a", 1: "B", 3: "d"}
    assert change.snapshot(source, "0/9") == 2  # done: nothing is read again
    assert (lag_tier(0), lag_tier(2 << 30), lag_tier(0, 7), lag_tier(60 << 30)) == ("ok", "notice", "warning", "critical")


def test_event_time_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2026-01-01 00:{i % 60:02d}:00", "k") for i in range(0, 120, 7)], "id long, t string, k string").select("id", F.col("t").cast("timestamp_ntz").alias("ts"), "k")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    count = F.count(F.lit(1)).alias("n")
    batch = windows.tumbling(windows.event_time(rows, "ts"), "ts", "10 minutes", ["k"], count)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    made = windows.tumbling(windows.event_time(stream, "ts", "1 day"), "ts", "10 minutes", ["k"], count)
    q = made.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, batch.collect()))
    on_time, late = windows.late_rows(windows.event_time(rows, "ts"), "ts", "2026-01-01 00:30:00")
    assert on_time.count() + late.count() == rows.count() and late.count() > 0
