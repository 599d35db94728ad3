"""Registered queries of the engine's own operators, each with the SQL that states the same rows.

Where rows come from inline data, the SQL states them as VALUES. Queries without SQL are held against brute force in
the tests.
"""

from __future__ import annotations

import struct
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import registry, scalars
from .operators import chain, joins
from .operators.transforms import AddColumn, Aggregate, Cast, Dedupe, Enrich, Filter, Flatten, Mask, Project, Rename, ScalarUdf, Select, Split, Union, Unnest, Validate, Virtual
from .plans import audit, metrics, sqlmode
from .plans.evolution import POLICIES, decide, diff
from .plans.run import Pipeline
from .plans.state import Store
from .sinks.base import LoadId
from .sinks.files import BatchFolders, dead_letters, event_log
from .sinks.keyed import KeyedTable, Routed
from .sinks.staging import Staged
from .sources import changes, cursor, readers
from .sources.cursor import CursorScan
from .sources.positions import GtidSet
from .sources.readers import Limits
from .streaming import windows
from .streaming.changes import lag_tiers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Rows of a keyed table's bucket, some 256 MB of two columns.
KEYED_ROWS = 16_000_000


class Tables:
    """Tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    def add(function: Callable[[Tables], DataFrame]):
        key = name or function.__name__
        QUERIES[key] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            ORACLE[key] = sql
        return function

    return add


def kept(frame: DataFrame, *operators) -> DataFrame:
    return chain.apply(list(operators), frame).kept


# ---- transforms ----


@query("SELECT c_mktsegment, c_custkey FROM customer")
def select_reorder(t):
    return kept(t.customer, Select(("c_mktsegment", "c_custkey")))


@query("SELECT c_custkey, c_name FROM customer WHERE nullif(c_nationkey, 7) IS NOT NULL")
def filter_is_not_null(t):
    rows = t.customer.select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(7)).alias("id"))
    return kept(rows, Filter("id IS NOT NULL", strict=True)).drop("id")


@query("SELECT c_custkey, c_name FROM customer WHERE nullif(c_nationkey, 7) IS NULL")
def filter_is_null(t):
    rows = t.customer.select("c_custkey", "c_name", F.nullif("c_nationkey", F.lit(7)).alias("id"))
    return kept(rows, Filter("id IS NULL", strict=True)).drop("id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 42")
def filter_eq_int(t):
    return kept(t.orders.select("o_orderkey", "o_custkey"), Filter("o_custkey = 42", strict=True))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P')")
def filter_in_strings(t):
    return kept(t.orders.select("o_orderkey", "o_orderstatus"), Filter("o_orderstatus IN ('F', 'P', NULL)", strict=True))


@query("SELECT p_partkey, p_size FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_name LIKE '%1%') AND NOT p_size % 3 = 0 AND p_retailprice * 2 > 1800.5")
def filter_full_language(t):
    return kept(t.part, Filter("(p_size BETWEEN 10 AND 20 OR p_name LIKE '%1%') AND NOT p_size % 3 = 0 AND p_retailprice * 2 > 1800.5"), Select(("p_partkey", "p_size")))


@query("SELECT c_custkey, sha256('pepper' || c_name) AS c_name FROM customer")
def mask_sha256(t):
    return kept(t.customer.select("c_custkey", "c_name"), Mask("c_name", "sha256", salt="pepper"))


@query()
def mask_blake3(t):
    return kept(t.customer.select("c_custkey", "c_name"), Mask("c_name"))


@query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def mask_null(t):
    return kept(t.customer.select("c_custkey", "c_name"), Mask("c_name", "null"))


@query("SELECT c_custkey, CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NOT NULL THEN '[REDACTED]' END AS segment FROM customer")
def mask_redact(t):
    rows = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
    return kept(rows, Mask("segment", "redact"))


@query("SELECT c_custkey, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS c_name FROM customer")
def mask_keep_last(t):
    return kept(t.customer.select("c_custkey", "c_name"), Mask("c_name", "redact", keep_last=4))


#: SHA-256's block with the key "a key", against the inner and the outer pad of HMAC.
_PADS = [bytes(b ^ pad for b in b"a key".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(f"SELECT c_custkey, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || c_name::BLOB))) AS c_name FROM customer")
def mask_tokenize(t):
    return kept(t.customer.select("c_custkey", "c_name"), Mask("c_name", "tokenize", key="a key"))


@query("SELECT r_regionkey, 'pg' AS origin, 7::BIGINT AS n, 1.5::DOUBLE AS f, true AS b, CAST(NULL AS INTEGER) AS nothing FROM region")
def add_column_literals(t):
    steps = [AddColumn("origin", "pg"), AddColumn("n", 7), AddColumn("f", 1.5), AddColumn("b", True), AddColumn("nothing", None, "int")]
    return kept(t.region.select("r_regionkey"), *steps)


@query("SELECT p_partkey, p_retailprice * 2 AS twice FROM part")
def add_column_expression(t):
    return kept(t.part.select("p_partkey", "p_retailprice"), AddColumn("twice", expression="p_retailprice * 2", type="double"), Project(drop=("p_retailprice",)))


def _people(t):
    return t.customer.select("c_custkey", F.nullif("c_nationkey", F.lit(7)).alias("id"), "c_acctbal")


@query("SELECT c_custkey, nullif(c_nationkey, 7) AS id, c_acctbal FROM customer WHERE nullif(c_nationkey, 7) IS NOT NULL")
def validate_kept(t):
    return kept(_people(t), Validate(("id",)))


@query("SELECT c_custkey, nullif(c_nationkey, 7) AS id, c_acctbal, 0 AS _rejected_by FROM customer WHERE nullif(c_nationkey, 7) IS NULL UNION ALL SELECT c_custkey, c_nationkey, c_acctbal, 1 FROM customer WHERE nullif(c_nationkey, 7) IS NOT NULL AND NOT c_acctbal > 0")
def validate_rejected(t):
    return chain.apply([Validate(("id",)), Validate(predicates=("c_acctbal > 0",))], _people(t)).rejected


@query("SELECT count(*) FILTER (WHERE c_nationkey = 7)::BIGINT AS rejected, count(*)::BIGINT AS total, count(*) FILTER (WHERE c_nationkey = 7) / count(*) > 0.01 AS over FROM customer")
def dead_letter_rate(t):
    out = chain.apply([Validate(("id",))], _people(t))
    rejected, total = out.rejected.count(), t.customer.count()
    return t.spark.createDataFrame([(rejected, total, chain.over_threshold(rejected, total))], "rejected long, total long, over boolean")


@query("SELECT c_custkey, c_name, upper(c_name) AS loud FROM customer")
def scalar_udf_upper(t):
    return kept(t.customer.select("c_custkey", "c_name"), ScalarUdf("upper@0.1.0", "c_name", "loud"))


@query("SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment, 'crm' AS origin FROM customer WHERE c_mktsegment = 'BUILDING'")
def chain_filter_mask_add(t):
    return kept(t.customer.select("c_custkey", "c_name", "c_mktsegment"), Filter("c_mktsegment = 'BUILDING'"), Mask("c_name", "sha256"), AddColumn("origin", "crm"))


@query("SELECT l_orderkey, l_quantity, l_extendedprice, sha256(l_shipinfo) AS l_shipinfo, 'lake' AS origin FROM (SELECT *, l_returnflag || l_linestatus AS l_shipinfo FROM lineitem) WHERE l_quantity >= 25")
def chain_lineitem(t):
    rows = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").alias("l_shipinfo"))
    return kept(rows, Filter("l_quantity >= 25"), Mask("l_shipinfo", "sha256"), AddColumn("origin", "lake"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def project_drop(t):
    return kept(t.supplier, Project(drop=("s_acctbal",)))


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part")
def project_matching(t):
    return kept(t.part, Project(keep_matching="p_(partkey|name|brand|t.*)"))


@query("SELECT n_nationkey AS id, n_name AS label, n_regionkey FROM nation")
def rename(t):
    return kept(t.nation, Rename({"n_nationkey": "id", "n_name": "label"}))


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice::DECIMAL(12, 2) AS p_retailprice FROM part")
def cast_decimal(t):
    return kept(t.part.select("p_partkey", "p_size", "p_retailprice"), Cast("p_size", "bigint"), Cast("p_retailprice", "decimal(12,2)", narrowing=True))


@query("SELECT c_custkey, try_cast(substr(c_name, 10) AS INTEGER) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'none' END AS c_name FROM customer)")
def cast_bad_values(t):
    rows = t.customer.select("c_custkey", F.substring(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("none"), 10, 100).alias("n"))
    return kept(rows, Cast("n", "int", narrowing=True, on_bad_value="null"))


@query("SELECT s_suppkey, s_nationkey, n_name, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def enrich_nation(t):
    return kept(t.supplier.select("s_suppkey", "s_nationkey"), Enrich(t.nation, {"s_nationkey": "n_nationkey"}, ("n_name", "n_regionkey")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedupe_last_by(t):
    return kept(t.events.select("user_id", "event_id", "event_type"), Dedupe(("user_id",), "last", "event_id"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def dedupe_any(t):
    return kept(t.events.select("user_id", "event_type"), Dedupe(("user_id", "event_type")))


@query("SELECT vec_id, (i - 1)::INTEGER AS at, embedding[i] AS x FROM embeddings, unnest(generate_series(1, len(embedding))) AS g(i)")
def unnest_embedding(t):
    return kept(t.embeddings.select("vec_id", "embedding"), Unnest("embedding", "x", "at"))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS props_k FROM events")
def flatten_props(t):
    rows = t.events.select("event_id", F.from_json("props", "k bigint").alias("props"))
    return kept(rows, Flatten("props"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'rest' END AS branch FROM orders")
def split_branches(t):
    step = Split({"large": "o_totalprice > 300000", "done": "o_orderstatus = 'F'"}, "rest")
    return kept(t.orders, step, Select(("o_orderkey", "branch")))


@query("SELECT n_regionkey, count(*)::BIGINT AS n, min(n_name) AS lo, max(n_name) AS hi, count(DISTINCT n_name)::BIGINT AS d FROM nation GROUP BY 1")
def aggregate_region(t):
    return kept(t.nation, Aggregate(("n_regionkey",), {"n": ("count", "*"), "lo": ("min", "n_name"), "hi": ("max", "n_name"), "d": ("count_distinct", "n_name")}))


@query("SELECT (event_id // 1000)::BIGINT AS batch, event_type, count(*)::BIGINT AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def aggregate_batches(t):
    rows = t.events.withColumn("batch", F.floor(F.col("event_id") / 1000).cast("long"))
    return kept(rows, Aggregate(("event_type",), {"n": ("count", "*"), "mean": ("avg", "value")}, ("batch",))).withColumn("mean", F.round("mean", 4))


@query()
def virtual_columns(t):
    return kept(t.customer.select("c_custkey"), Virtual(now="at", started_at="2026-01-01 00:00:00", random="r", of=("c_custkey",)))


# ---- incremental scans, change logs, keyed state ----


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM (SELECT o_orderdate FROM orders ORDER BY o_orderdate LIMIT 100))")
def cursor_page(t):
    return cursor.CursorScan("o_orderdate", ("o_orderkey",), ("o_orderkey", "o_orderdate")).page(t.orders, None, 100)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")
def cursor_resume(t):
    from .plans.state import Cursor

    return cursor.CursorScan("o_orderdate", ("o_orderkey",), ("o_orderkey", "o_orderdate")).after(t.orders, Cursor("timestamp_tz", "1996-01-01T00:00:00.000000Z"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
def backfill_window(t):
    return cursor.CursorScan("o_orderdate", ("o_orderkey",), ("o_orderkey", "o_orderdate")).window(t.orders, "1995-01-01T00:00:00Z", "1995-02-01T00:00:00Z")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 5000 ORDER BY o_orderkey LIMIT 1000")
def snapshot_chunk(t):
    return cursor.snapshot_chunk(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 5000, 1000)


def _folder(t: Tables) -> str:
    """A new folder in the cluster's shared one; only where that is unset, in a temporary one."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and t.spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    shared = shared or tempfile.mkdtemp(prefix="sluice-")
    return f"{shared}/tables-{uuid.uuid4().hex}"


def _buckets(rows: DataFrame) -> int:
    return max(4, -(-rows.count() // KEYED_ROWS))


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 5000 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def keyed_upsert(t):
    """Two slices, the later one wins: what a keyed table holds after both loads."""
    first = t.orders.where("o_orderkey < 10000").select("o_orderkey", "o_totalprice")
    second = t.orders.where("o_orderkey >= 5000").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    table = KeyedTable(t.spark, _folder(t), ("o_orderkey",), _buckets(t.orders))
    for batch, rows in enumerate((first, second)):
        table.load(LoadId("queries", "keyed_upsert", "orders", batch), rows)
    return table.read()


def _log(t):
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "i").otherwise("u")
    return t.events.select(F.col("user_id").alias("id"), "value", op.alias("_cdc.op"), F.lit("0/1").alias("_cdc.lsn"), F.col("ts").cast("timestamp").alias("_cdc.commit_ts"), F.lit(1).cast("long").alias("_cdc.txid"), F.col("event_id").alias("_cdc.seq"))


_LAST = "SELECT user_id, value, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query(f"SELECT user_id AS id, value FROM ({_LAST}) WHERE event_type <> 'error'")
def cdc_apply_final_state(t):
    return changes.current_state(_log(t), ["id"])


@query("SELECT CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'i' ELSE 'u' END AS op, event_type = 'error' AS late, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def cdc_event_log(t):
    """All change rows go to the append-only log, in two batches, of which the second comes twice."""
    sink, rows = event_log(_folder(t)), _log(t)
    for batch, part in enumerate((rows.where(changes.meta("op") != "d"), rows.where(changes.meta("op") == "d"))):
        for _ in range(1 + batch):
            made = sink.load(LoadId("queries", "cdc_event_log", "r", batch), part)
    logged = t.spark.read.parquet(made.path.rsplit("/", 1)[0])
    return logged.groupBy(changes.meta("op").alias("op"), (F.col("batch") == 1).alias("late")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id AS id, value FROM ({_LAST}) WHERE event_type <> 'error'")
def cdc_keyed_table(t):
    """The log applied to a keyed table in two batches, cut at a value of the sequence, the second one twice."""
    table, log = KeyedTable(t.spark, _folder(t), ("id",), _buckets(t.events)), _log(t)
    middle = t.events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for batch, part in ((0, changes.meta("seq") <= middle), (1, changes.meta("seq") > middle), (1, changes.meta("seq") > middle)):
        table.load(LoadId("queries", "cdc", "r", batch), log.where(part))
    return table.read()


@query(f"SELECT user_id AS id, value, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM ({_LAST.replace('event_id FROM', 'event_id, ts FROM')})")
def cdc_keyed_soft_delete(t):
    table = KeyedTable(t.spark, _folder(t), ("id",), _buckets(t.events), deletes="column")
    table.load(LoadId("queries", "cdc", "r", 0), _log(t))
    return table.read().select("id", "value", F.col("_deleted_at").cast("timestamp_ntz").alias("deleted_at"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def sink_batch_folders(t):
    """A batch for each status; one of them comes again and replaces its folder."""
    sink, rows = BatchFolders(_folder(t)), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    states = sorted(r[0] for r in rows.select("o_orderstatus").distinct().collect())
    for batch, state in [*enumerate(states), (0, states[0])]:
        made = sink.load(LoadId("queries", "folders", "r", batch, "orders"), rows.where(F.col("o_orderstatus") == state))
    return t.spark.read.parquet(made.path.rsplit("/", 1)[0]).drop("batch")


@query("SELECT event_type AS stream, event_id, value FROM events")
def sink_routed(t):
    """Rows of several streams, each to its own table."""
    sink = Routed(t.spark, _folder(t), keys=("event_id",), buckets=_buckets(t.events))
    rows = t.events.select("event_id", "value", F.col("event_type").alias("_stream"))
    loaded = sink.load_streams(LoadId("queries", "routed", "r", 0), rows)
    return reduce(DataFrame.unionByName, [sink.of(s).read().select(F.lit(s).alias("stream"), "event_id", "value") for s in sorted(loaded)])


@query("SELECT c_custkey, c_nationkey, 'kept' AS went FROM customer WHERE c_nationkey <> 7 UNION ALL SELECT c_custkey, c_nationkey, 'dead' FROM customer WHERE c_nationkey = 7")
def sink_dead_letters(t):
    sink, dead = BatchFolders(_folder(t)), dead_letters(_folder(t))
    out = chain.apply([Validate(predicates=("c_nationkey <> 7",))], t.customer.select("c_custkey", "c_nationkey"))
    load = LoadId("queries", "customers", "r", 0)
    paths = {"kept": sink.load(load, out.kept).path, "dead": dead.load(load, out.rejected).path}
    return reduce(DataFrame.unionByName, [t.spark.read.parquet(p).select("c_custkey", "c_nationkey", F.lit(k).alias("went")) for k, p in paths.items()])


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN s_acctbal END AS s_acctbal, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def sink_evolution(t):
    """A second batch adds a column and widens another; rows of the first have null in the new one."""
    table = KeyedTable(t.spark, _folder(t), ("s_suppkey",), _buckets(t.supplier))
    first = t.supplier.where("s_nationkey >= 12").select("s_suppkey", "s_nationkey")
    second = t.supplier.where("s_nationkey < 12").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_acctbal")
    for batch, rows in enumerate((first, second)):
        table.load(LoadId("queries", "evolution", "r", batch), rows)
    return table.read()


@query("SELECT max(o_orderkey) AS o_orderkey, o_custkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def upsert_repeated_keys(t):
    """A batch that has a key many times leaves its last row."""
    table = KeyedTable(t.spark, _folder(t), ("o_custkey",), _buckets(t.orders), order=("o_orderkey",))
    table.load(LoadId("queries", "repeated", "r", 0), t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))
    return table.read()


class _Failing(KeyedTable):
    """Fails once, after its second batch is loaded and before anyone hears of it."""

    failed = False

    def load(self, load, batch):
        done = super().load(load, batch)
        if load.batch == 1 and not self.failed:
            self.failed = True
            raise OSError("the run ends here")
        return done


@query("SELECT o_orderkey, nullif(o_orderdate, TIMESTAMP '1995-01-02') AS o_orderdate, o_totalprice FROM orders")
def run_after_crash(t):
    """An incremental run in some eight batches that crashes in the second and comes again; one day's rows have no cursor
    value. The destination only appends, so a row that is loaded twice or passed over shows."""
    rows = t.orders.select("o_orderkey", F.nullif("o_orderdate", F.lit("1995-01-02").cast("timestamp_ntz")).alias("o_orderdate"), "o_totalprice")
    at = _folder(t)
    sink = _Failing(t.spark, f"{at}/table")
    p = Pipeline(t.spark, Store(t.spark, at), "queries", "crash", "orders", CursorScan("o_orderdate", ("o_orderkey",), resume="strict"), sink, batch_size=max(1, t.orders.count() // 8))
    try:
        p.run(rows, "r", attempts=1)
    except OSError:
        p.run(rows, "r", attempts=1)
    return sink.read()


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders")
def sink_staged_run(t):
    """Half of the orders change within the run: both rows of such a key are staged, one merge at the run's end keeps the
    later one. A first run is bounded to two batches, a second one takes up from there."""
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice")
    earlier = rows.where("o_totalprice > 150000").select("o_orderkey", F.expr("o_orderdate - INTERVAL 400 DAYS").alias("o_orderdate"), F.lit(0.0).alias("o_totalprice"))
    at, size = _folder(t), max(1, t.orders.count() // 4)
    sink = Staged(KeyedTable(t.spark, f"{at}/table", ("o_orderkey",), _buckets(t.orders)), f"{at}/staging")
    for name, limits in (("first", Limits(batches=2)), ("second", Limits())):
        Pipeline(t.spark, Store(t.spark, at), "queries", "staged", "orders", CursorScan("o_orderdate", ("o_orderkey",)), sink, batch_size=size, limits=limits).run(rows.union(earlier), name, attempts=1)
    return sink.table.read()


@query("SELECT unnest(['etl_activity_duration_seconds', 'etl_rows_loaded_total', 'etl_rows_read_total', 'etl_rows_rejected_total', 'etl_runs_completed_total', 'etl_runs_failed_total', 'etl_runs_started_total']) AS name, unnest([1, n, n, 0, 1, 0, 1])::DOUBLE AS value FROM (SELECT count(*) AS n FROM orders)")
def run_metrics(t):
    """The counters of one run; its duration is given as 1 if there is one."""
    at, rows = _folder(t), t.orders.select("o_orderkey", "o_orderdate")
    store = Store(t.spark, at)
    Pipeline(t.spark, store, "queries", "metrics", "orders", CursorScan("o_orderdate", ("o_orderkey",), resume="strict"), BatchFolders(f"{at}/out"), batch_size=max(1, rows.count())).run(rows, "r", attempts=1)
    found = metrics.rows(t.spark, metrics.of_runs(store, "metrics"))
    return found.select("name", F.when(F.col("name") == metrics.DURATION_SECONDS, F.ceil(F.least("value", F.lit(1.0))).cast("double")).otherwise(F.col("value")).alias("value"))


@query("SELECT event_id, CASE WHEN event_id * 67108864 >= 53687091200 OR value / 4 >= 24 THEN 'critical' WHEN event_id * 67108864 >= 10737418240 OR value / 4 >= 6 THEN 'warning' WHEN event_id * 67108864 >= 1073741824 OR value / 4 >= 1 THEN 'notice' ELSE 'ok' END AS tier FROM events")
def slot_lag_tiers(t):
    return t.events.select("event_id", lag_tiers(F.col("event_id") * (1 << 26), F.col("value") / 4).alias("tier"))


class _Lines:
    """The items of a text between commas, numbered."""

    def eval(self, text: str):
        for i, item in enumerate((text or "").split(",")):
            yield i, item


@query("SELECT p_partkey, i::INTEGER AS nth, word FROM (SELECT p_partkey, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT p_partkey, string_split(replace(p_name, ' ', ','), ',') AS ws FROM part))")
def table_function(t):
    registry.register_table(t.spark, "sluice_items@0.1.0", _Lines, "nth int, word string")
    rows = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(",")).alias("items"))
    return registry.apply_table("sluice_items@0.1.0", rows, "items").drop("items")


_RELATION = changes.Relation(7, "public", "items", [("id", 20, True), ("name", 25, False)])


def _message(tag: str, form: str, *values) -> bytes:
    return tag.encode() + struct.pack(">" + form, *values)


def _cells(*values: str | None) -> bytes:
    return struct.pack(">H", len(values)) + b"".join(b"n" if v is None else b"t" + struct.pack(">I", len(v.encode())) + v.encode() for v in values)


def _items_log(t):
    """A recorded log: two rows; then an update, a delete and an insert, each transaction with its commit."""
    relation = _message("R", "I", 7) + b"public\0items\0d" + struct.pack(">H", 2) + b"\x01id\0" + struct.pack(">Ii", 20, -1) + b"\x00name\0" + struct.pack(">Ii", 25, -1)
    row = lambda kind, *v: kind.encode() + _cells(*v)
    begin, commit = lambda n: _message("B", "QqI", n, 0, n), lambda n: _message("C", "BQQq", 0, n, n, 0)
    first = [begin(1), relation, _message("I", "I", 7) + row("N", "1", "a"), _message("I", "I", 7) + row("N", "2", "b"), commit(1)]
    second = [begin(2), _message("U", "I", 7) + row("N", "1", "a-prime"), _message("D", "I", 7) + row("K", "2", None), _message("I", "I", 7) + row("N", "3", "c"), commit(2)]
    log = t.spark.createDataFrame([(0, i, m) for i, m in enumerate([*first, *second])], "segment int, seq long, data binary")
    return changes.decode_log(log, "items", changes.table_schema(_RELATION))


@query("SELECT * FROM (VALUES ('i', 1::BIGINT, 'a', '0/1', 1::BIGINT), ('i', 2, 'b', '0/1', 1), ('u', 1, 'a-prime', '0/2', 2), ('d', 2, NULL, '0/2', 2), ('i', 3, 'c', '0/2', 2)) AS v(op, id, name, lsn, txid)")
def cdc_decoded_log(t):
    return _items_log(t).select(changes.meta("op").alias("op"), "id", "name", changes.meta("lsn").alias("lsn"), changes.meta("txid").alias("txid"))


@query("SELECT * FROM (VALUES (1::BIGINT, 'a-prime'), (3, 'c')) AS v(id, name)")
def cdc_decoded_state(t):
    table = KeyedTable(t.spark, _folder(t), ("id",), 2)
    table.load(LoadId("queries", "items", "r", 0), _items_log(t))
    return table.read()


@query("SELECT * FROM (VALUES (1::BIGINT, 'stream-1'), (2, 'snap-2'), (3, 'stream-3')) AS v(id, name)")
def cdc_converge(t):
    """Snapshot rows and log rows of the same keys in either batch: the log's count."""
    rows = [("s", 1, "snap-1", -1), ("s", 2, "snap-2", -1), ("u", 1, "stream-1", 5), ("i", 3, "stream-3", 6)]
    made = t.spark.createDataFrame([(i, n, op, "0/1", None, 1, q) for op, i, n, q in rows], "id long, name string, `_cdc.op` string, `_cdc.lsn` string, `_cdc.commit_ts` timestamp, `_cdc.txid` long, `_cdc.seq` long")
    table = KeyedTable(t.spark, _folder(t), ("id",), 2)
    for batch, op in enumerate((changes.meta("op") == "s", changes.meta("op") != "s")):
        table.load(LoadId("queries", "items", "r", batch), made.where(op))
    return table.read()


@query("SELECT * FROM (VALUES ('u:1-10', 'u:11-20', 'u:1-20', false), ('u:1-10:15', 'v:3', 'u:1-10:15,v:3', false), ('u:1-10', 'u:3-4', 'u:1-10', true)) AS v(a, b, both_, holds)")
def gtid_sets(t):
    rows = [("u:1-10", "u:11-20"), ("u:1-10:15", "v:3"), ("u:1-10", "u:3-4")]
    made = [(a, b, str(GtidSet.parse(a).union(GtidSet.parse(b))), str(GtidSet.parse(a).union(GtidSet.parse(b))) == a) for a, b in rows]
    return t.spark.createDataFrame(made, "a string, b string, both_ string, holds boolean")


@query("SELECT * FROM (VALUES ('strict', 'add', 'reject'), ('strict', 'drop', 'reject'), ('propagate_additive', 'add', 'accept'), ('propagate_additive', 'drop', 'reject'), ('freeze', 'add', 'retain_old'), ('freeze', 'drop', 'retain_old'), ('propagate_all', 'add', 'accept'), ('propagate_all', 'drop', 'accept')) AS v(policy, what, action)")
def schema_policies(t):
    held = t.supplier.schema
    new = {"add": T.StructType([*held.fields, T.StructField("s_rating", T.DoubleType())]), "drop": t.supplier.drop("s_acctbal").schema}
    rows = [(p, what, decide(diff(held, s), p).action) for p in POLICIES for what, s in new.items()]
    return t.spark.createDataFrame(rows, "policy string, what string, action string")


@query("SELECT n_regionkey::VARCHAR AS tenant, false AS is_broken, count(*)::BIGINT AS n FROM nation GROUP BY 1")
def audit_chain(t):
    """A chain for each region over its nations; of a sound chain no row is broken."""
    held = {}
    for r in t.nation.orderBy("n_nationkey").collect():  # a table of fixed size
        held.setdefault(str(r["n_regionkey"]), []).append({"id": r["n_nationkey"], "what": r["n_name"]})
    rows = [(k, e["id"], e["body"], e["prev_hash"], e["hash"]) for k, v in held.items() for e in audit.chained(v)]
    log = t.spark.createDataFrame(rows, "tenant string, id long, body string, prev_hash string, hash string")
    return log.join(audit.broken(log).select("tenant", "id", F.lit(True).alias("bad")), ["tenant", "id"], "left").groupBy("tenant", F.coalesce("bad", F.lit(False)).alias("is_broken")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, upper(event_type) AS event_type, value * 2 AS value FROM events WHERE value > 10")
def udf_batch(t):
    """A registered function of batches that drops rows and changes cells."""

    def louder(batches):
        for b in batches:
            b = b[b["value"] > 10]
            yield b.assign(event_type=b["event_type"].str.upper(), value=b["value"] * 2)

    registry.register_batch("louder@1.0.0", louder, registry.schema_rule("identity"))
    return registry.apply_batch("louder@1.0.0", t.events.select("event_id", "event_type", "value"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1")
def udf_aggregate(t):
    spread = registry.aggregate(lambda v: float(v.max() - v.min()))
    return t.events.groupBy("event_type").agg(spread(F.col("value")).alias("spread")).withColumn("spread", F.round("spread", 6))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-15' AS late FROM events")
def window_late_rows(t):
    """Rows before a watermark go to a side output."""
    rows = windows.event_time(t.events.select("event_id", "ts"), "ts")
    there, late = windows.late_rows(rows, "ts", "2024-01-15 00:00:00")
    return there.select("event_id", F.lit(False).alias("late")).unionAll(late.select("event_id", F.lit(True).alias("late")))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def fan_in(t):
    here = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    there = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return kept(here, Union(there))


@query(f"SELECT user_id AS id, value FROM ({_LAST}) WHERE event_type <> 'error'")
def cdc_snapshot_handoff(t):
    """A snapshot up to a position, and the log from before it: the overlap changes nothing."""
    log = _log(t)
    pinned = changes.current_state(log.where(changes.meta("seq") <= 5000), ["id"])
    both = changes.snapshot(pinned, "0/1", "id").unionByName(log.where(changes.meta("seq") > 4900))
    return changes.current_state(both, ["id"])


@query("SELECT user_id AS id, value, CASE WHEN event_type = 'error' THEN ts END AS deleted_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def cdc_soft_delete(t):
    last = cursor.latest(_log(t), ["id"], ["_cdc.seq"])
    return last.select("id", "value", F.when(changes.meta("op") == "d", changes.meta("commit_ts")).cast("timestamp_ntz").alias("deleted_at"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def reconcile_deleted_keys(t):
    return cursor.deleted_keys(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT * FROM (VALUES ('add_column', 's_rating', '', 'double'), ('drop_column', 's_acctbal', 'double', '')) AS v(kind, name, was, now)")
def schema_diff(t):
    new = T.StructType([*t.supplier.drop("s_acctbal").schema.fields, T.StructField("s_rating", T.DoubleType())])
    found = diff(t.supplier.schema, new)
    return t.spark.createDataFrame([(c.kind, c.column, c.old, c.new) for c in found], "kind string, name string, was string, now string")


@query("SELECT * FROM (VALUES (0::BIGINT, '1', 'Ann'), (1, '2', 'Bob'), (2, '3', 'C, D')) AS v(_row_index, id, name)")
def csv_inline(t):
    return readers.csv_text(t.spark, 'id,name\n1,Ann\n2,Bob\n3,"C, D"\n')


@query("SELECT * FROM (VALUES ('cus_1', 'a@x.org', 'Ann', 1700000000::BIGINT), ('cus_2', NULL, NULL, 1700000001)) AS v(id, email, name, created)")
def rest_pages(t):
    body = '{"data": [{"id": "cus_1", "email": "a@x.org", "name": "Ann", "created": 1700000000}, {"id": "cus_2", "email": null, "name": null, "created": 1700000001}], "has_more": false}'
    return readers.read_pages(t.spark, t.spark.createDataFrame([(body,)], "body string"))


@query("SELECT (event_id % 7)::VARCHAR AS tenant, event_type AS metric, ts::DATE AS day, round(sum(value), 4) AS total, count(*)::BIGINT AS n_events FROM events GROUP BY 1, 2, 3")
def metering_daily(t):
    rows = t.events.select(F.col("event_id"), (F.col("event_id") % 7).cast("string").alias("tenant"), F.col("event_type").alias("metric"), "value", F.col("ts").alias("emitted_at"))
    return audit.metered(rows.union(rows.where("event_id % 5 = 0"))).withColumn("total", F.round("total", 4))


# ---- joins ----


def _segment(t):
    return t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice")


_C = "(SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING')"
_O = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders)"

for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):

    def _joined(t, how=_how):
        c, o = _segment(t), _orders(t)
        return c.join(o, c.c_custkey == o.o_custkey, how)

    query(f"SELECT * FROM {_C} {_word} {_O} ON c_custkey = o_custkey", f"join_{_how}")(_joined)


@query(f"SELECT * FROM {_C} SEMI JOIN {_O} ON c_custkey = o_custkey")
def join_semi(t):
    c, o = _segment(t), _orders(t)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query(f"SELECT * FROM {_C} ANTI JOIN {_O} ON c_custkey = o_custkey")
def join_anti(t):
    c, o = _segment(t), _orders(t)
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("SELECT r_name, n.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey ORDER BY n_name LIMIT 2) n")
def join_lateral(t):
    near = t.nation.where(F.col("n_regionkey") == F.col("r_regionkey").outer()).orderBy("n_name").limit(2).select("n_name")
    return t.region.lateralJoin(near).select("r_name", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def not_in(t):
    return joins.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.where("o_totalprice > 200000"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 3) FROM orders WHERE o_custkey <> 5)")
def not_in_null_aware(t):
    """A null among the other keys leaves nothing."""
    return joins.not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.where("o_custkey <> 5").select(F.nullif("o_custkey", F.lit(3)).alias("k")), "k")


# ---- aggregates, windows, order, sets ----

_Q1 = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""


@query(_Q1)
def pricing_summary(t):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def group_having(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 15")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, list(n_name ORDER BY n_name) AS listed FROM nation GROUP BY 1")
def string_agg_ordered(t):
    names = F.array_sort(F.collect_list("n_name"))
    return t.nation.groupBy("n_regionkey").agg(F.array_join(names, ",").alias("names"), names.alias("listed"))


@query("SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS mid, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS high FROM events GROUP BY 1")
def percentiles(t):
    t.events.createOrReplaceTempView("sluice_events")
    return t.spark.sql("SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS mid, percentile_disc(0.9) WITHIN GROUP (ORDER BY value) AS high FROM sluice_events GROUP BY 1")


@query()
def approx_distinct(t):
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("SELECT n_regionkey, count(DISTINCT n_name)::BIGINT AS d, count(*) FILTER (WHERE n_name < 'J')::BIGINT AS early, bool_or(n_nationkey = 3) AS has FROM nation GROUP BY 1")
def distinct_and_filtered(t):
    return t.nation.groupBy("n_regionkey").agg(F.count_distinct("n_name").alias("d"), F.count_if(F.col("n_name") < "J").alias("early"), F.bool_or(F.col("n_nationkey") == 3).alias("has"))


def _ranked(name: str, column: Callable, sql: str) -> None:
    query(f"SELECT o_orderkey, {sql} AS v FROM orders", name)(lambda t: t.orders.select("o_orderkey", column().alias("v")))


def _by():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


def _prio():
    return Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")


def _lag_lead():
    return F.coalesce(F.lag("o_totalprice").over(_by()), F.lit(0.0)) + F.coalesce(F.lead("o_totalprice").over(_by()), F.lit(0.0))


def _first_last():
    whole = _by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.first_value("o_orderkey").over(whole) * 1000000 + F.last_value("o_orderkey").over(whole)


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_ranked("win_row_number", lambda: F.row_number().over(_by()), f"(row_number() {_OVER}))::INTEGER")
_ranked("win_rank", lambda: F.rank().over(_prio()), "(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INTEGER")
_ranked("win_dense_rank", lambda: F.dense_rank().over(_prio()), "(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority))::INTEGER")
_ranked("win_lag_lead", _lag_lead, f"coalesce(lag(o_totalprice) {_OVER}), 0.0) + coalesce(lead(o_totalprice) {_OVER}), 0.0)")
_ranked("win_first_last", _first_last, f"first_value(o_orderkey) {_OVER} {_FRAME} * 1000000 + last_value(o_orderkey) {_OVER} {_FRAME}")
_ranked("win_sum_over", lambda: F.round(F.sum("o_totalprice").over(_by().rowsBetween(Window.unboundedPreceding, 0)), 2), f"round(sum(o_totalprice) {_OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2)")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def order_limit_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(5).limit(10)


def _sets(t):
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier"


@query(f"{_A} UNION {_B}")
def union_distinct(t):
    a, b = _sets(t)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def union_all(t):
    a, b = _sets(t)
    return a.union(b)


@query(f"{_A} INTERSECT {_B}")
def intersect(t):
    a, b = _sets(t)
    return a.intersect(b)


@query(f"{_A} WHERE c_nationkey < 12 EXCEPT {_B} WHERE s_nationkey > 5")
def except_(t):
    a, b = _sets(t)
    return a.where("k < 12").subtract(b.where("k > 5"))


# ---- the SQL subset ----


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query in the engine's SQL; the oracle is the same text unless given."""

    def run(t):
        for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            if table in text:
                getattr(t, table).createOrReplaceTempView(table)
        return sqlmode.validate(t.spark, text)

    query(oracle or text, name)(run)


sql_query("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
sql_query("scalar_subquery", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
sql_query("in_subquery", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
sql_query("exists_subquery", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
sql_query("case_cast", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_totalprice AS BIGINT)::STRING AS whole FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, trunc(o_totalprice)::BIGINT::VARCHAR AS whole FROM orders")
sql_query("fn_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_name) AS l, trim(concat('  ', c_mktsegment, NULL, ' ')) AS t, substring(c_name, 3, 4) AS s, replace(c_name, 'o', '0') AS r, split_part(c_name, '#', 2) AS p, md5(c_name) AS h FROM customer")
sql_query("fn_date", "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(o_orderdate + INTERVAL 3 DAYS AS DATE) AS d FROM orders")
sql_query("fn_json", "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
sql_query("fn_arithmetic", "SELECT p_partkey, p_size % 7 AS m, abs(p_size - 25) AS a, floor(p_retailprice) AS f, round(sqrt(p_retailprice), 6) AS s FROM part", "SELECT p_partkey, p_size % 7 AS m, abs(p_size - 25) AS a, floor(p_retailprice)::BIGINT AS f, round(sqrt(p_retailprice), 6) AS s FROM part")
sql_query("three_way_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")


@query("SELECT c_custkey, regexp_extract_all(c_name, '[0-9]+') AS found, [substr(c_name, 1, 1)] AS first FROM customer")
def fn_regexp(t):
    return t.customer.select("c_custkey", F.regexp_extract_all("c_name", F.lit("[0-9]+"), F.lit(0)).alias("found"), scalars.regexp_matches(F.col("c_name"), "^(.)").alias("first"))


@query("SELECT i AS id, b, d, n FROM (VALUES (1, true, DATE '2026-01-01', 45045123456::BIGINT), (2, false, NULL, NULL), (3, NULL, NULL, NULL)) AS v(i, b, d, n)")
def text_parsers(t):
    rows = t.spark.createDataFrame([(1, "t", "2026-01-01", "12:30:45.123456"), (2, "0", "2026-13-01", "25:00:00"), (3, "yes", None, "x")], "id int, b string, d string, n string")
    return rows.select("id", scalars.parse_bool(F.col("b"), "null").alias("b"), scalars.parse_date(F.col("d"), "null").alias("d"), scalars.parse_time_us(F.col("n"), "null").alias("n"))


# ---- event time ----


def _flat(frame):
    return frame.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


def _n():
    return F.count(F.lit(1)).alias("n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3")
def tumbling_window(t):
    return _flat(windows.tumbling(windows.event_time(t.events, "ts"), "ts", "1 hour", ["event_type"], _n()))


@query("SELECT w AS window_start, w + INTERVAL 1 DAY AS window_end, event_type, count(*)::BIGINT AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS w FROM events) GROUP BY 1, 2, 3")
def sliding_window(t):
    return _flat(windows.sliding(windows.event_time(t.events, "ts"), "ts", "1 day", "12 hours", ["event_type"], _n()))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, s""")
def session_window(t):
    return _flat(windows.session(windows.event_time(t.events, "ts"), "ts", "6 hours", ["user_id"], _n()))


@query("SELECT count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events")
def global_window(t):
    return windows.overall(t.events, _n(), F.round(F.sum("value"), 4).alias("total"))


# ---- text ----


@query("SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[EMAIL]', 'g') AS text FROM documents")
def mask_documents(t):
    return t.documents.select("doc_id", F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[EMAIL]").alias("text"))


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({_HTML}, '[\\t\\n\\x0B\\f\\r ]+', ' ', 'g'), ' ') AS text FROM pages")
def html_text_pages(t):
    return readers.documents_as_html_text(t.pages.select("page_id", "html")).drop("html")
