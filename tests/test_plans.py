"""Evolution, state, specs, runs, SQL and audit."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.transforms import Filter, Mask, Validate
from sluice.plans import audit, evolution, metrics, run, spec, sqlmode
from sluice.plans.state import BackwardsCursor, Cursor, Positions, Store
from sluice.sinks.files import BatchFolders, dead_letters
from sluice.sinks.base import LoadId, SinkError
from sluice.sinks.keyed import KeyedTable
from sluice.sinks.staging import EMITTED, Staged
from sluice.sources.cursor import CursorScan
from sluice.sources.positions import GtidSet, lsn, lsn_number, lsn_text
from sluice.sources.readers import Limits
from sluice.sources.slots import PreflightError, Slot, mysql_preflight


def schema(*fields):
    kinds = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[t], nullable) for n, t, nullable in fields])


BASE = schema(("id", "bigint", False), ("name", "string", True))


def plus(name, kind):
    return T.StructType([*BASE.fields, T.StructField(name, kind)])


def test_fingerprint():
    assert evolution.fingerprint(BASE) == evolution.fingerprint(T.StructType(BASE.fields[::-1]))
    assert evolution.fingerprint(BASE) != evolution.fingerprint(schema(("id", "bigint", True), ("name", "string", True)))


@pytest.mark.parametrize(
    "new, kinds",
    [
        (BASE, []),
        (schema(("id", "bigint", False), ("name", "string", True), ("x", "int", True)), ["add_column"]),
        (schema(("id", "bigint", False)), ["drop_column"]),
        (schema(("id", "int", False), ("name", "string", True)), ["narrow"]),
        (schema(("id", "bigint", True), ("name", "string", True)), ["make_nullable"]),
        (schema(("name", "string", True), ("id", "bigint", False)), ["reorder"]),
    ],
)
def test_diff(new, kinds):
    assert [c.kind for c in evolution.diff(BASE, new)] == kinds


def test_policies():
    add = evolution.diff(BASE, plus("x", T.IntegerType()))
    drop = evolution.diff(BASE, schema(("id", "bigint", False)))
    assert evolution.decide([]).action == "noop"
    assert evolution.decide(add).action == "accept" and evolution.decide(drop).action == "reject"
    assert evolution.decide(add, "strict").action == "reject" and evolution.decide(add, "freeze").action == "retain_old"
    assert evolution.decide(drop, "propagate_all").action == "accept"
    assert evolution.decide(add, overrides={"x": "protect"}).action == "reject" and evolution.decide(drop, overrides={"name": "ignore"}).action == "noop"
    required = evolution.diff(BASE, T.StructType([*BASE.fields, T.StructField("x", T.IntegerType(), False)]))
    assert evolution.decide(required).action == "reject"
    assert evolution.likely_renames(evolution.diff(BASE, schema(("id", "bigint", False), ("label", "string", True)))) == [("name", "label")]


def test_recorder(spark, tmp_path):
    recorder = evolution.Recorder(Store(spark, str(tmp_path)), "p/customers")
    assert recorder.resolve(BASE).version == 1 and recorder.resolve(BASE).version == 1
    second = recorder.resolve(plus("nickname", T.StringType()))
    assert (second.version, second.parent) == (2, 1) and [(c["kind"], c["column"]) for c in second.changes] == [("add_column", "nickname")]
    with pytest.raises(evolution.SchemaRejected):
        recorder.resolve(BASE)
    assert recorder.resolve(BASE, "freeze").version == 2


def test_positions(spark, tmp_path):
    held = Positions(Store(spark, str(tmp_path)))
    assert held.get("p", "s") is None
    held.commit("p", "s", Cursor("lsn", "0/A"))
    held.commit("p", "s", Cursor("lsn", "0/10"))  # later, though its text is smaller
    with pytest.raises(BackwardsCursor):
        held.commit("p", "s", Cursor("lsn", "0/B"))
    held.commit("p", "s", Cursor("lsn", "0/B"), backwards=True)
    assert held.get("p", "s") == Cursor("lsn", "0/B")
    with pytest.raises(ValueError):
        Cursor("guess", "1")


def test_log_positions(spark):
    assert lsn_text(lsn("16/B374D848")) == "16/B374D848"
    assert int(spark.range(1).select(lsn_number(F.lit("16/B374D848"))).first()[0]) == lsn("16/B374D848")
    assert str(GtidSet.parse("u:1-10").union(GtidSet.parse("u:11-20"))) == "u:1-20"
    assert str(GtidSet.parse("u:1-10:15,v:3")) == "u:1-10:15,v:3"
    assert ("u", 15) in GtidSet.parse("U:1-10:15") and ("u", 12) not in GtidSet.parse("u:1-10:15")
    for bad in ("u:5-1", "u", "u:0"):
        with pytest.raises(ValueError):
            GtidSet.parse(bad)


YAML = """
apiVersion: platform.etl/v0
kind: Connection
metadata: {name: db}
spec: {host: h}
---
apiVersion: platform.etl/v0
kind: Pipeline
metadata: {name: p}
spec:
  source: {table: customers, cursor_field: updated_at}
  destination: {path: /x}
  transform:
    - {kind: filter, predicate: id IS NOT NULL}
    - {kind: mask, column: email, how: hash}
"""


def test_specs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert spec.apply(store, YAML) == {"Connection/db": "created", "Pipeline/p": "created"}
    assert set(spec.apply(store, YAML).values()) == {"unchanged"}
    assert spec.changed(store, YAML.replace("host: h", "host: i")) == {"Connection/db": ["host"], "Pipeline/p": []}
    assert [o.kind for o in spec.operators(spec.get(store, "Pipeline", "p")["transform"])] == ["filter", "mask"]
    for bad in (YAML.replace("v0", "v9"), YAML.replace("kind: Connection", "kind: Else"), YAML.replace("cursor_field", "cursor"), YAML.replace("kind: mask", "kind: paint")):
        with pytest.raises(spec.SpecError):
            spec.apply(store, bad)


def customers(spark, n, first=1):
    at = [(i, f"n{i}", None if i in (2, 6) else f"e{i}@x.org", f"2026-04-20 10:{i // 2:02d}:00") for i in range(first, first + n)]
    return spark.createDataFrame(at, "id long, name string, email string, u string").withColumn("updated_at", F.col("u").cast("timestamp")).drop("u")


def pipeline(spark, tmp_path, sink=None, **more):
    sink = sink or KeyedTable(spark, str(tmp_path / "table"), ("id",), buckets=4)
    return run.Pipeline(spark, Store(spark, str(tmp_path)), "t", "p", "customers", CursorScan("updated_at", ("id",)), sink, **more)


def test_incremental_run(spark, tmp_path):
    p = pipeline(spark, tmp_path, batch_size=4)
    first = p.run(customers(spark, 10), "r1")
    assert first.state == "completed" and p.sink.read().count() == 10 and first.cursor == "2026-04-20T10:05:00.000000Z"
    again = p.run(customers(spark, 10), "r2")
    assert (again.read, again.loaded) == (0, 0)
    # id 11 has the boundary's cursor value: only an inclusive resume finds it
    third = p.run(customers(spark, 15), "r3")
    assert p.sink.read().count() == 15 and third.overlap > 0 and third.read == third.loaded


class Broken(KeyedTable):
    """Fails at one load, before or after the rows are there."""

    at, after = None, False

    def load(self, load, batch):
        if load.batch == self.at and not self.after:
            Broken.at = None
            raise OSError("gone")
        done = super().load(load, batch)
        if load.batch == self.at:
            Broken.at = None
            raise OSError("gone")
        return done


@pytest.mark.parametrize("at", [0, 1, 2, 6])
@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("keys", [("id",), ()])
def test_crash_in_any_batch(spark, tmp_path, at, after, keys):
    """A run that failed and comes again under its id loads each row once, also where rows moved on meanwhile."""
    rows = spark.range(30).select("id", F.col("id").cast("string").alias("name"), F.when(F.col("id") % 10 != 9, F.col("id")).alias("at"))
    sink = Broken(spark, str(tmp_path / "t"), keys, 3)
    p = run.Pipeline(spark, Store(spark, str(tmp_path)), "t", "p", "s", CursorScan("at", ("id",), resume="strict"), sink, batch_size=4)
    Broken.at, Broken.after = at, after
    with pytest.raises(OSError):
        p.run(rows, "r1", attempts=1)
    moved = rows.withColumn("at", F.when(F.col("id") == 9 * 10 // 9 - 2, 100).otherwise(F.col("at"))) if keys else rows
    assert p.run(moved, "r1", attempts=1).state == "completed"
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(30))
    assert p.run(moved, "r2").loaded == 0


def test_rows_without_a_cursor(spark, tmp_path):
    rows = spark.range(30).select("id", F.when(F.col("id") % 5 != 2, F.col("id")).alias("at"))
    for size in (10, 100):
        p = run.Pipeline(spark, Store(spark, str(tmp_path / f"s{size}")), "t", "p", "s", CursorScan("at", ("id",)), KeyedTable(spark, str(tmp_path / f"t{size}"), ("id",), 2), batch_size=size)
        out = p.run(rows, "r1")
        assert (out.read - out.overlap, p.sink.read().count()) == (30, 30)
        assert p.run(rows, "r2").loaded == 0


def test_repeated_keys_in_a_run(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, "new"), (1, 3, "old"), (2, None, "x"), (2, 1, "y"), (3, 4, "a"), (3, 4, "b")], "id long, at long, name string")
    p = run.Pipeline(spark, Store(spark, str(tmp_path)), "t", "p", "s", CursorScan("at", ("id",)), KeyedTable(spark, str(tmp_path / "t"), ("id",), 2))
    p.run(rows, "r1")
    assert sorted((r["id"], r["name"]) for r in p.sink.read().collect()) == [(1, "new"), (2, "y"), (3, "b")]


def test_documents_survive_a_crash(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(4):
        store.put("a/b", i)
    assert store.get("a/b") == 3 and len(store.files.names("a/b.doc")) == 2
    (tmp_path / "_state/a/b.doc/000000000009.json.x.tmp").write_text("{")  # a write that never ended
    assert store.get("a/b") == 3 and store.get("a", "none") == "none"


def test_fan_in_and_enrich_by_name(spark, tmp_path):
    from sluice.operators import chain

    spark.createDataFrame([(1, "one")], "k long, label string").write.parquet(str(tmp_path / "ref"))
    more = spark.createDataFrame([(9, 1.5)], "id long, x double")
    more.createOrReplaceTempView("more_rows")
    steps = spec.operators([{"kind": "enrich", "reference": str(tmp_path / "ref"), "on": {"id": "k"}, "columns": ["label"]}, {"kind": "union", "reference": "more_rows"}])
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    got = chain.apply(steps, rows).kept
    assert got.schema == chain.derive_schema(steps, rows.schema)
    assert sorted(map(tuple, got.collect())) == [(1, "one", None), (2, None, None), (9, None, 1.5)]
    with pytest.warns(UserWarning, match="deletes"):
        chain.apply([Filter("id > 1")], rows.withColumn("_cdc.op", F.lit("d")))


def test_ties_beyond_a_page(spark, tmp_path):
    rows = customers(spark, 10).withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    p = pipeline(spark, tmp_path, batch_size=3)
    p.run(rows, "r1")
    assert p.sink.read().count() == 10


def test_ties_at_an_inclusive_position(spark, tmp_path):
    """More rows at the position than a page takes: the rows behind them still come."""
    rows = spark.range(30).select("id", F.when(F.col("id") < 12, 0).otherwise(F.col("id")).alias("at"))
    sink = KeyedTable(spark, str(tmp_path / "t"), ("id",), 2)
    run.Pipeline(spark, Store(spark, str(tmp_path)), "t", "p", "s", CursorScan("at", ("id",)), sink, batch_size=5).run(rows, "r1")
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(30))


class Crash(Exception):
    pass


def staged(spark, tmp_path, keys=("id",), **more):
    sink = Staged(KeyedTable(spark, str(tmp_path / "t"), keys, 3), str(tmp_path / "staging"))
    return run.Pipeline(spark, Store(spark, str(tmp_path)), "t", "p", "s", CursorScan("at", ("id",), resume="strict"), sink, batch_size=7, **more), sink


@pytest.mark.parametrize("where, same, keys", [("batch", True, ()), ("batch", False, ("id",)), ("before_load", False, ()), ("after_load", True, ()), ("after_commit", True, ("id",))])
def test_staged_run_survives_a_crash(spark, tmp_path, monkeypatch, where, same, keys):
    """Nothing shows before a run's commit; whatever comes after a crash, each row is there once."""
    rows = spark.range(30).select("id", F.when(F.col("id") % 10 != 9, F.col("id")).alias("at"))
    p, sink = staged(spark, tmp_path, keys)
    p.batch_size = 14
    calls = {"n": 0}

    def crash(target, name, nth=1, after=False):
        real = getattr(target, name)

        def run_(*a, **k):
            calls["n"] += 1
            if calls["n"] != nth:
                return real(*a, **k)
            if after:
                real(*a, **k)
            raise Crash

        monkeypatch.setattr(target, name, run_)

    {"batch": lambda: crash(sink, "load", 3), "before_load": lambda: crash(sink, "commit"), "after_load": lambda: crash(sink, "abort"), "after_commit": lambda: crash(sink, "commit", after=True)}[where]()
    with pytest.raises(Crash):
        p.run(rows, "r1", attempts=1)
    if where in ("batch", "before_load"):
        assert not sink.table.versions()
    monkeypatch.undo()
    more = rows.union(spark.sql("SELECT 100L AS id, 100L AS at"))
    assert p.run(more, "r1" if same else "r2", attempts=1).state == "completed"
    p.run(more, "r3")
    assert sorted(r["id"] for r in sink.table.read().collect()) == [*range(30), 100]
    assert not sink._folders(LoadId("t", "p", "r1", 0, "s"))


def test_staged_ties_and_abort(spark, tmp_path):
    """Of rows with one key the highest cursor counts, of equal ones the batch emitted last; aborted rows are gone."""
    p, sink = staged(spark, tmp_path)
    sink.order = ("at",)
    load = lambda n: LoadId("t", "p", "r", n, "s")
    for n, text in enumerate(("(1, 5, 'a'), (2, 9, 'a')", "(1, 5, 'b'), (2, 8, 'b')")):
        for _ in range(2):
            sink.load(load(n), spark.sql(f"SELECT * FROM VALUES {text} AS v(id, at, name)"))
    sink.commit(load(2))
    sink.commit(load(2))
    assert sorted((r["id"], r["name"]) for r in sink.table.read().collect()) == [(1, "b"), (2, "a")]
    assert sink.table.versions() == [1]
    sink.load(load(3), spark.sql("SELECT 7 AS id, 7 AS at, 'x' AS name"))
    sink.abort(load(3))
    assert sink.commit(load(4)).rows == 0
    with pytest.raises(SinkError):
        sink.load(load(5), spark.sql(f"SELECT 1 AS id, 1 AS {EMITTED}"))


@pytest.mark.parametrize("limits, batches", [(Limits(rows=8), 2), (Limits(batches=3), 3), (Limits(bytes=1), 1), (Limits(seconds=0), 0)])
def test_limits(spark, tmp_path, limits, batches):
    rows = spark.range(30).select("id", F.col("id").alias("at"))
    p, sink = staged(spark, tmp_path, limits=limits)
    done = p.run(rows, "r1")
    assert (done.batches, done.more, done.read) == (batches, True, 7 * batches)
    p.limits = Limits()
    done = p.run(rows, "r2")
    assert done.read == 30 - 7 * batches and not done.more
    assert sink.table.read().count() == 30


def test_metrics(spark, tmp_path):
    p, _ = staged(spark, tmp_path)
    p.run(spark.range(9).select("id", F.col("id").alias("at")), "r1")
    found = metrics.of_runs(p.store, "p") | metrics.of_changes(4, 10)
    assert len(found) == 9 and found[metrics.ROWS_READ] == 9 and found[metrics.RUNS_COMPLETED] == 1
    assert 'etl_rows_read_total{pipeline="a\\"b"} 9\n' in metrics.exposition(found, pipeline='a"b')
    assert sum(metrics.of_runs(p.store, "none").values()) == 0


def test_preflight_and_slot(spark, tmp_path):
    assert mysql_preflight({"GTID_MODE": "on", "binlog_format": "ROW"}, {"s.t"}, "s.t") == []
    assert len(mysql_preflight({"binlog_format": "MIXED"}, set(), "s.t")) == 3
    slot = Slot(Store(spark, str(tmp_path)), "one")
    with pytest.raises(PreflightError):
        slot.confirmed()
    assert slot.ensure(("a",), "0/10") == "0/10" and slot.ensure(("b",), "0/FF") == "0/10" and slot.tables() == ["a", "b"]
    assert slot.advance("0/20") == "0/20" and slot.advance("0/15") == "0/20"
    assert slot.lag("1/20") == 1 << 32 and slot.lag("0/1") == 0
    slot.release()
    slot.release()
    with pytest.raises(PreflightError):
        slot.lag("0/1")


def test_batches_that_keep_nothing(spark, tmp_path):
    p = pipeline(spark, tmp_path, batch_size=3, operators=[Filter("id > 8")])
    out = p.run(customers(spark, 10), "r1")
    assert out.read >= 10 and {r["id"] for r in p.sink.read().collect()} == {9, 10}


def test_dead_letters(spark, tmp_path):
    ops = [Mask("name"), Validate(("email",))]
    dead = dead_letters(str(tmp_path / "out"))
    p = pipeline(spark, tmp_path, operators=ops, dead_letter=dead, threshold=0.5)
    out = p.run(customers(spark, 10), "r1")
    assert (out.rejected, p.sink.read().count()) == (2, 8)
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out/t/p/customers/dead-letter/r1")).collect()} == {2, 6}
    with pytest.raises(run.RunFailed):
        pipeline(spark, tmp_path / "b", operators=ops, threshold=0.05).run(customers(spark, 10), "r1")
    assert Store(spark, str(tmp_path / "b")).get("runs/p/r1")["state"] == "failed"


def test_crash_after_load_before_commit(spark, tmp_path):
    p = pipeline(spark, tmp_path)
    real, calls = Positions.commit, []

    def fails(self, *a, **b):
        calls.append(a)
        raise OSError("gone")

    Positions.commit = fails
    try:
        with pytest.raises(OSError):
            p.run(customers(spark, 10), "r1")
    finally:
        Positions.commit = real
    assert p.run(customers(spark, 10), "r1").loaded == 0 and p.sink.read().count() == 10


def test_retries_and_suspension(spark, tmp_path):
    class Flaky(BatchFolders):
        left = [2]

        def load(self, load, batch):
            if self.left[0]:
                self.left[0] -= 1
                raise OSError("again")
            return super().load(load, batch)

    p = pipeline(spark, tmp_path, sink=Flaky(str(tmp_path / "f")))
    assert p.run(customers(spark, 4), "r1", wait=0.01).loaded == 4
    p.store.put("tenants/t", {"status": "suspended"})
    with pytest.raises(run.RunFailed):
        p.run(customers(spark, 4), "r2")


def test_sql_subset(spark):
    spark.createDataFrame([(1, "a", '{"k": {"z": 5}}'), (2, None, "{}")], "id int, s string, j string").createOrReplaceTempView("t")
    ok = lambda text: [tuple(r) for r in sqlmode.validate(spark, text, {"t"}).collect()]
    assert ok("SELECT id, concat(s, 'x', NULL) FROM t ORDER BY id") == [(1, "ax"), (2, "x")]
    assert ok("SELECT j -> 'k' ->> 'z' FROM t WHERE id = 1") == [("5",)]
    assert ok("WITH c AS (SELECT id FROM t) SELECT max(id) FROM c") == [(2,)]
    assert ok("SELECT 'now()' AS x FROM t WHERE id = 1") == [("now()",)]
    assert ok("SELECT row_number() OVER (PARTITION BY s ORDER BY id) FROM t WHERE id = 1") == [(1,)]
    for bad in (
        "DROP TABLE t", "CREATE TABLE x AS SELECT 1", "INSERT INTO t VALUES (1)", "SELECT now()", "SELECT current_timestamp", "SELECT rand()", "SELECT current_user()", "SELECT 1; SELECT 2",
        "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", "SELECT row_number() OVER (ORDER BY id) FROM t", "SELECT uuid()",
    ):
        with pytest.raises(sqlmode.Refused):
            sqlmode.validate(spark, bad, {"t"})
    frame = sqlmode.validate(spark, "SELECT * FROM t")
    assert "Physical Plan" in sqlmode.explain(frame) and sqlmode.estimate(frame)["bytes"] > 0
    assert ok("SELECT concat(array(1, 2), array(id)) FROM t WHERE id = 1") == [([1, 2, 1],)]
    assert ok('SELECT "a ->> \'b\'" AS x, "concat(1)" AS y FROM t WHERE id = 1') == [("a ->> 'b'", "concat(1)")]
    assert ok("SELECT '{\"x y\": 7}' AS j, j ->> 'x y' FROM t WHERE id = 1") == [('{"x y": 7}', None)]
    assert ok("SELECT m ->> 'x y' FROM (SELECT '{\"x y\": 7}' AS m)") == [("7",)]
    with pytest.raises(sqlmode.Refused):
        sqlmode.validate(spark, "SELECT concat(s, 'x'), concat(array(1), array(2)) FROM t")


def test_bounds(spark, tmp_path):
    spark.range(1000).repartition(16).write.parquet(str(tmp_path / "r"))
    spark.read.parquet(str(tmp_path / "r")).createOrReplaceTempView("r")
    frame = sqlmode.validate(spark, "WITH x AS (SELECT id FROM r) SELECT a.id FROM x a JOIN r b ON a.id = b.id WHERE a.id < 900")
    assert sqlmode.scanned(frame) == 2000
    assert sqlmode.bounded(frame, sqlmode.Bounds(), str(tmp_path / "a")).count() == 900
    assert sqlmode.bounded(frame, sqlmode.Bounds(rows_scanned=2000, rows_out=900), str(tmp_path / "b")).count() == 900
    for i, bounds in enumerate((sqlmode.Bounds(rows_out=899), sqlmode.Bounds(rows_out=150), sqlmode.Bounds(rows_scanned=1999))):
        with pytest.raises(sqlmode.TooMany):
            sqlmode.bounded(frame, bounds, str(tmp_path / f"c{i}"))
        assert not (tmp_path / f"c{i}").exists()


def test_results(spark):
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("t")
    results = sqlmode.Results()
    assert results.get(spark, "SELECT id FROM t", {"t": 1}) is results.get(spark, "SELECT  id FROM t", {"t": 1})


def test_audit(spark):
    log = audit.chained([{"id": i, "what": f"w{i}"} for i in range(5)])
    frame = spark.createDataFrame([("t", e["id"], e["body"], e["prev_hash"], e["hash"]) for e in log], "tenant string, id long, body string, prev_hash string, hash string")
    assert audit.broken(frame).count() == 0
    bent = frame.withColumn("body", F.when(F.col("id") == 2, "{}").otherwise(F.col("body")))
    assert [r["id"] for r in audit.broken(bent).collect()] == [2]
    assert audit.prunable(frame, 1).count() == 2


def test_preview_and_refresh(spark, tmp_path):
    rows = customers(spark, 10)
    assert run.preview(rows, [Filter("id > 3")], 5).count() == 2
    from sluice.sinks.base import LoadId

    table = KeyedTable(spark, str(tmp_path / "t"), ("id",), 2)
    run.full_refresh(rows, [], table, LoadId("t", "p", "r", 0))
    run.full_refresh(rows.where("id < 4"), [], table, LoadId("t", "p", "r", 1))
    assert table.read().count() == 3
