"""Readers by connector reference: constant rows, CSV text, paged JSON and Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Stream:
    """What a source says of a stream: schema, keys, modes, and cursor columns with how they grow."""

    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    modes: tuple[str, ...] = ("full_refresh", "append", "incremental")
    cursors: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Limits:
    """Bounds of one read; ``bytes`` of its rows as JSON."""

    rows: int | None = None
    batches: int | None = None
    bytes: int | None = None
    seconds: float | None = None


def greeting(spark: SparkSession) -> DataFrame:
    """Three constant rows."""
    return spark.createDataFrame([(1, "hello"), (2, "world"), (3, "again")], "id long not null, greeting string not null")


def csv_lines(text: str) -> list[list[str]]:
    import csv
    import io

    rows = list(csv.reader(io.StringIO(text)))
    if rows and any(len(r) != len(rows[0]) for r in rows):
        raise SourceError("rows of different lengths")
    return rows


def csv_text(spark: SparkSession, text: str, header: bool = True, after: int | None = None) -> DataFrame:
    """Inline CSV: a row index that keeps counting, and every column as text. Ragged rows are an error."""
    rows = csv_lines(text)
    names = rows[0] if header and rows else [f"column_{i}" for i in range(len(rows[0]) if rows else 0)]
    body = rows[1:] if header else rows
    schema = T.StructType([T.StructField("_row_index", T.LongType(), False), *[T.StructField(n, T.StringType()) for n in names]])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(body) if after is None or i > after], schema)


def csv_files(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True) -> DataFrame:
    """CSV files of a known schema; ragged rows fail."""
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST", enforceSchema=False)


class PageSource(DataSource):
    """A paged REST resource. Pages are taken one after the other: each request needs the last id of the page before.

    Options: ``pages`` (a folder of recorded pages ``0.json``, ...) or a ``fetch`` given to ``read_pages``."""

    @classmethod
    def name(cls) -> str:
        return "sluice_pages"

    def schema(self) -> str:
        return CUSTOMER

    def reader(self, schema):
        return _PageReader(self.options)


class _PageReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        import os

        folder = self.options["pages"]

        def recorded(after: str | None, limit: int) -> tuple[int, str]:
            for name in sorted(os.listdir(folder), key=lambda n: int(n.split(".")[0])):
                with open(os.path.join(folder, name)) as f:
                    body = f.read()
                page = json.loads(body)
                if page.get("_after") == after:
                    return page.get("_status", 200), body
            return 200, json.dumps({"data": [], "has_more": False})

        yield from pages(recorded, int(self.options.get("limit", "100")), self.options.get("after"))


CUSTOMER = "id string not null, email string, name string, created long"


def pages(fetch: Callable[[str | None, int], tuple[int, str]], limit: int = 100, after: str | None = None, retries: int = 3) -> Iterator[tuple]:
    """Rows of all pages from a position on. ``fetch(after, limit)`` gives status and body; 429 is tried again."""
    more = True
    while more:
        for _ in range(retries + 1):
            status, body = fetch(after, limit)
            if status != 429:
                break
        if status != 200:
            raise SourceError(f"status {status}")
        page = json.loads(body)
        for row in page["data"]:
            yield row["id"], row.get("email"), row.get("name"), row.get("created")
            after = row["id"]
        more = bool(page.get("has_more")) and bool(page["data"])


def read_pages(spark: SparkSession, bodies: DataFrame) -> DataFrame:
    """Rows of recorded page bodies (a column ``body``), parsed by a fixed schema in the executors."""
    parsed = F.from_json("body", f"data array<struct<{', '.join(c.strip().replace(' not null', '').replace(' ', ': ', 1) for c in CUSTOMER.split(','))}>>")
    return bodies.select(F.inline(parsed.getField("data")))


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel by key ranges. The driver's jar must be on the cluster."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def documents_as_html_text(pages_: DataFrame, html: str = "html", output: str = "text") -> DataFrame:
    """The visible text of HTML pages, by patterns: scripts, styles and tags go, entities of the common kind are read."""
    c = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return pages_.withColumn(output, F.trim(F.regexp_replace(c, r"\s+", " ")))


READERS: dict[str, Callable[..., DataFrame]] = {"hello": greeting, "csv": csv_text, "parquet": parquet, "jdbc": jdbc}


def connector(reference: str) -> tuple[str, Callable[..., DataFrame] | None]:
    """How a reference is run: ``bounded`` or ``continuous``, and its reader. ``name@version``, ``wasm:`` and
    ``wasm-cdc:`` references name bundled or user connectors; here those are registered Python readers."""
    if reference.startswith("wasm-cdc:"):
        return "continuous", None
    name = reference.removeprefix("wasm:").split("@")[0]
    if name not in READERS:
        raise SourceError(f"unknown connector_ref {reference!r}")
    return "bounded", READERS[name]


def smoke(frame: DataFrame, discovered: T.StructType, rows: int) -> None:
    """The three checks that every connector passes."""
    if not discovered.fields:
        raise SourceError("discover gave no columns")
    if [f.name for f in discovered] != frame.columns:
        raise SourceError("columns differ from what was discovered")
    if frame.limit(rows + 1).count() > rows:
        raise SourceError(f"more than {rows} rows")
