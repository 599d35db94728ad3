"""A checked, deterministic subset of SQL: one query, over registered tables, that gives the same rows each time.

A statement is parsed by Spark and its plan is walked: commands, recursive queries, windows without a partition and
expressions that differ from run to run are refused. Functions and operators that Spark lacks or defines otherwise are
rewritten first.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .state import Files


class Refused(ValueError):
    pass


@dataclass(frozen=True)
class Bounds:
    rows_scanned: int = 1_000_000_000
    rows_out: int = 100_000_000


#: Functions that give something else each time, or say who asks.
VARYING = ("now", "current_timestamp", "current_date", "localtimestamp", "current_time", "rand", "random", "randn", "uuid", "shuffle", "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "monotonically_increasing_id", "spark_partition_id", "input_file_name", "java_method", "reflect")
_LITERAL = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.DOTALL)
_STATEMENT = re.compile(r"^\s*(\(|select\b|with\b|values\b|from\b)", re.IGNORECASE)


def _code(text: str) -> str:
    """The statement with the insides of literals and comments blanked, for looking at its words."""
    blank = lambda m: m.group(0)[0] + " " * (len(m.group(0)) - 2) + m.group(0)[-1] if m.group(0)[0] in "'\"`" else " " * len(m.group(0))
    return _LITERAL.sub(blank, text)


def rewrite(text: str, texts: bool = True) -> str:
    """``a ->> 'k'`` and ``a -> 'k'`` as paths, ``concat`` of texts that skips nulls, ``regexp_matches``. Works on the
    statement's words: literals, quoted names and comments come back as they were."""
    held: list[str] = []

    def hide(m: re.Match) -> str:
        held.append(m.group(0))
        return f"\x01{len(held) - 1}\x02"

    code = _LITERAL.sub(hide, text)
    arrow = re.compile(r"((?:\w+|\x01\d+\x02)(?:\.(?:\w+|\x01\d+\x02))?|get_json_object\([^()]*(?:\([^()]*\)[^()]*)*\))\s*->>?\s*\x01(\d+)\x02")
    while m := arrow.search(code):
        key = held[int(m.group(2))]
        if key[0] != "'":
            raise Refused(f"a key in quotes is needed after the arrow, not {key}")
        held.append(f"'$.{key[1:-1]}'" if re.fullmatch(r"'\w+'", key) else f"'$[\\'{key[1:-1]}\\']'")
        code = f"{code[: m.start()]}get_json_object({m.group(1)}, \x01{len(held) - 1}\x02){code[m.end() :]}"
    code = re.sub(r"\bregexp_matches\s*\(", "regexp_extract_all(", code, flags=re.IGNORECASE)
    if texts:
        code = re.sub(r"\bconcat\s*\(", "concat_ws('', ", code, flags=re.IGNORECASE)
    return re.sub(r"\x01(\d+)\x02", lambda m: held[int(m.group(1))], code)


def _concat_of(spark: SparkSession, text: str) -> set[str]:
    """The types that the statement's calls of ``concat`` give, as Spark has them."""
    if not re.search(r"\bconcat\s*\(", _code(text), re.IGNORECASE):
        return set()
    plan = spark.sql(rewrite(text, texts=False))._jdf.queryExecution().analyzed()
    found, rest = set(), []
    for node, _ in _nodes(plan):
        rest += [node.expressions().apply(i) for i in range(node.expressions().size())]
    while rest:
        e = rest.pop()
        if e.getClass().getSimpleName() == "Concat":
            found.add("text" if e.dataType().catalogString() == "string" else "other")
        rest += [e.children().apply(i) for i in range(e.children().size())]
    return found


def _nodes(plan):
    """All nodes of a plan with their kinds, those of subqueries and named queries too."""
    rest = [plan]
    while rest:
        node = rest.pop()
        yield node, node.getClass().getSimpleName()
        for more in (node.children(), node.subqueries(), node.innerChildren()):
            found = more.iterator()
            while found.hasNext():
                inner = found.next()
                if hasattr(inner, "subqueries"):
                    rest.append(inner)


def _named(code: str) -> set[str]:
    """Names that the statement itself gives to queries."""
    return {m.group(1).lower() for m in re.finditer(r"(?:\bwith|,)\s+(\w+)(?:\s*\([^)]*\))?\s+as\s*\(", code, re.IGNORECASE)}


def validate(spark: SparkSession, text: str, tables: set[str] | None = None) -> DataFrame:
    """The query's DataFrame, not run, or the reason why it is refused."""
    code = _code(text)
    if ";" in code.rstrip().rstrip(";"):
        raise Refused("one statement only")
    text = text.rstrip().rstrip(";")
    if not _STATEMENT.match(code):
        raise Refused("only queries")
    if re.search(r"\bwith\s+recursive\b", code, re.IGNORECASE):
        raise Refused("recursive query")
    for name in VARYING:
        bare = name.startswith(("current_", "localt", "session_", "user"))
        if re.search(rf"\b{name}\b\s*\(" if not bare else rf"(?<![.\w]){name}\b(?!\s*\.)", code, re.IGNORECASE):
            raise Refused(f"{name} isn't deterministic")
    kinds = _concat_of(spark, text)
    if len(kinds) > 1:
        raise Refused("concat of texts and of other values in one query")
    frame = spark.sql(rewrite(text, kinds != {"other"}))
    plan = frame._jdf.queryExecution().analyzed()
    for node, kind in _nodes(plan):
        if kind in ("UnionLoop", "UnionLoopRef") or kind == "CTERelationRef" and node.recursive():
            raise Refused("recursive query")
        if kind == "Window" and node.partitionSpec().isEmpty():
            raise Refused("a window needs PARTITION BY")
        if kind.endswith(("Command", "Statement")) or kind.startswith(("Create", "Drop", "Insert", "Append", "Overwrite", "Delete", "Update", "Merge", "Alter")):
            raise Refused("only queries")
    if not plan.deterministic():
        raise Refused("the query isn't deterministic")
    if tables is not None:
        used = {node.identifier().name().lower() for node, kind in _nodes(plan) if kind == "SubqueryAlias"} & {t.name.lower() for t in spark.catalog.listTables()}
        unknown = used - {t.lower() for t in tables} - _named(code)
        if unknown:
            raise Refused("unknown table: " + ", ".join(sorted(unknown)))
    return frame


def estimate(frame: DataFrame) -> dict[str, int]:
    """What the optimiser thinks a query's result takes."""
    stats = frame._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return {"bytes": int(str(stats.sizeInBytes())), "rows": int(str(rows.get())) if rows.isDefined() else -1}


def explain(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class TooMany(RuntimeError):
    """A query beyond its bounds."""


def scanned(frame: DataFrame) -> int:
    """Rows of the tables that the query reads, before any filter; of Parquet tables their footers say how many."""
    classic = frame.sparkSession._jvm.org.apache.spark.sql.classic.Dataset
    leaves = [node for node, kind in _nodes(frame._jdf.queryExecution().analyzed()) if kind != "CTERelationRef" and not node.children().size() and node.output().size()]
    return sum(classic.ofRows(frame.sparkSession._jsparkSession, leaf).count() for leaf in leaves)


def bounded(frame: DataFrame, bounds: Bounds, path: str) -> DataFrame:
    """The query's rows, written to a new table at ``path`` and read from there; fails beyond a bound.

    Rows scanned are counted before the query runs. Rows out are counted by the tasks that write them, and each task
    stops by itself at the bound, so a query far beyond it doesn't fill the folder; a result beyond it is removed."""
    read = scanned(frame)
    if read > bounds.rows_scanned:
        raise TooMany(f"it reads {read} rows; the bound is {bounds.rows_scanned}")
    spark = frame.sparkSession
    seen = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    count = Observation()
    frame.where(seen <= F.lit(bounds.rows_out)).observe(count, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(path)
    if count.get["rows"] > bounds.rows_out:
        Files(spark, path).remove("")
        raise TooMany(f"it gives more than {bounds.rows_out} rows")
    return spark.read.schema(frame.schema).parquet(path)


@dataclass
class Results:
    """Results by text and table versions."""

    held: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def key(text: str, versions: dict[str, int]) -> str:
        return hashlib.sha256((" ".join(text.split()) + repr(sorted(versions.items()))).encode()).hexdigest()

    def get(self, spark: SparkSession, text: str, versions: dict[str, int]) -> DataFrame:
        k = self.key(text, versions)
        if k not in self.held:
            self.held[k] = validate(spark, text).persist()
        return self.held[k]


def pushed_bounds(frame: DataFrame, cursor: str) -> list[str]:
    """Filters on the cursor that reach the scan."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return re.findall(rf"(?:GreaterThan|GreaterThanOrEqual|LessThan|LessThanOrEqual|EqualTo)\({cursor},[^)]*\)", plan)
