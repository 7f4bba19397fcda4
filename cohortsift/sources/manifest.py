"""What is known of many Parquet files without opening them: columns, rows and ranges of values.

A manifest is a dataset with a row for each data file: the name it was asked for, its path,
rows, schema, and the least and largest value of its columns of whole numbers, dates, times without a
zone, and text. Executors list the names and read the footers, in one job however many files there are. A list of files then
opens without a look into any of them, is counted without a scan, and a range of a column
leaves out the files that cannot hold it.

Names are files or folders of files (their partition columns, if any, are not looked at).
``take`` reads names anew that are there already; the last look counts. A file that is replaced must
be taken again, as for any index. The footers are read with Arrow's file systems.

Defined results: columns are the first file's, as for a scan without a manifest; a name without
files, or one never taken, is an error; a range holds no NULL; floating columns have no bounds here,
as their bounds leave out NaN, which Spark puts above all numbers.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from types import FunctionType
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.sqltext import quoted
from cohortsift.sources.lake import united

_LISTED = "name string, path string, size bigint"
_FOUND = f"{_LISTED}, rows bigint, schema string, bounds map<string, struct<kind: string, low: string, high: string>>"
#: Names a task looks at, if there are enough of them.
AT_ONCE = 32

Range = tuple[Any, Any]
Task = Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]


def _opened(path: str) -> tuple[Any, str]:
    """The file system of a path, and the path there."""
    from pyarrow import fs

    # file:/a and file:///a are the same place
    return fs.FileSystem.from_uri(path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def _listed() -> Task:
    """A task that turns names into the data files there. All it uses is inside: executors need not have this package."""
    opened = _by_value(_opened)

    def files_of(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, base = opened(name)
                info = system.get_file_info(base)
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(name)
                files = [info]
                if info.type == fs.FileType.Directory:
                    files = system.get_file_info(fs.FileSelector(base, recursive=True))
                found = [(f.path[len(info.path) :], f.size) for f in files if f.type == fs.FileType.File]
                # Files of a job at work or done start with such signs.
                found = [(b, n) for b, n in found if not any(p.startswith(("_", ".")) for p in b.split("/"))]
                columns = [[name] * len(found), [name.rstrip("/") + below for below, _ in found], [size for _, size in found]]
                arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["name", "path", "size"])

    return files_of


def _looked() -> Task:
    """A task that reads the footers of files; self-contained as well."""
    opened = _by_value(_opened)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        import json

        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        bound = pa.struct([("kind", pa.string()), ("low", pa.string()), ("high", pa.string())])
        added = {"rows": pa.int64(), "schema": pa.string(), "bounds": pa.map_(pa.string(), bound)}

        def kind_of(column: pa.DataType) -> str | None:
            if pa.types.is_signed_integer(column):
                return "number"
            if pa.types.is_string(column) or pa.types.is_large_string(column):
                return "text"
            if pa.types.is_timestamp(column):
                return "time" if column.tz is None and column.unit in ("ms", "us") else None
            return "date" if pa.types.is_date32(column) else None

        def bounds_of(footer: pq.FileMetaData, schema: pa.Schema) -> list:
            found: dict = {}
            unknown = set()
            for group in range(footer.num_row_groups):
                part = footer.row_group(group)
                for place in range(part.num_columns):
                    column = part.column(place)
                    name, stats = column.path_in_schema, column.statistics
                    if name not in schema.names or kind_of(schema.field(name).type) is None:
                        continue
                    if stats is not None and stats.has_min_max:
                        try:
                            low, high = found.get(name, (stats.min, stats.max))
                            found[name] = min(low, stats.min), max(high, stats.max)
                        except (OverflowError, ValueError):  # a time Python has no value for
                            unknown.add(name)
                    elif stats is None or not stats.has_null_count or stats.null_count < part.num_rows:
                        unknown.add(name)
            return [
                (name.lower(), {"kind": kind_of(schema.field(name).type), "low": str(low), "high": str(high)})
                for name, (low, high) in found.items()
                if name not in unknown
            ]

        for batch in batches:
            rows = []
            for path in batch.column(1).to_pylist():
                system, place = opened(path)
                with system.open_input_file(place) as source:
                    file = pq.ParquetFile(source)
                    footer, schema = file.metadata, file.schema.to_arrow_schema()
                    stated = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                    text = stated.decode() if stated else json.dumps(from_arrow_schema(schema, prefer_timestamp_ntz=True).jsonValue())
                    rows.append((footer.num_rows, text, bounds_of(footer, schema)))
            own = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(added.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *added])

    return look


def _by_value(helper: FunctionType) -> FunctionType:
    """The same function as one that is sent to executors whole, and not by its module's name."""
    own = FunctionType(helper.__code__, {"__builtins__": __builtins__}, helper.__name__)
    own.__module__ = "__main__"
    return own


def _kind(column: T.DataType) -> str | None:
    if isinstance(column, T.IntegralType):
        return "number"
    if isinstance(column, T.StringType):
        return "text"
    if isinstance(column, T.TimestampNTZType):
        return "time"
    return "date" if isinstance(column, T.DateType) else None


class Manifest:
    """The manifest kept in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def take(self, names: Sequence[str]) -> None:
        """Look at files, or folders of files, and remember what is there: one job."""
        distinct = list(dict.fromkeys(names))
        if not distinct:
            return
        tasks = -(-len(distinct) // AT_ONCE)
        asked = self.spark.createDataFrame([(name,) for name in distinct], "name string").repartition(tasks)
        # Footers are dealt out anew: a name may be a folder of most of the files.
        files = asked.mapInArrow(_listed(), _LISTED).repartition(max(tasks, 4 * self.spark.sparkContext.defaultParallelism), "path")
        looks = self._rows().agg(F.max("look").alias("last")).first()["last"] or 0
        found = files.mapInArrow(_looked(), _FOUND).withColumn("look", F.lit(looks + 1))
        found.write.mode("append").parquet(f"{self.root}/files")

    def _rows(self) -> DataFrame:
        schema = T.StructType.fromDDL(f"{_FOUND}, look int")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/files")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        """A row for each data file of each name, as it was found by the last look at the name."""
        rows = self._rows()
        last = rows.groupBy("name").agg(F.max("look").alias("look"))
        return rows.join(last, ["name", "look"], "left_semi")

    def _named(self, names: Sequence[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(name,) for name in dict.fromkeys(names)], "name string")
        return self.files().join(asked, "name", "left_semi")

    def counts(self, names: Sequence[str]) -> DataFrame:
        """name and rows: how many there are in each, a name given twice once."""
        return self._named(names).groupBy("name").agg(F.sum("rows").alias("rows"))

    def scan(self, names: Sequence[str], ranges: Mapping[str, Range] | None = None) -> DataFrame:
        """The rows of all files under the first one's columns, within ``ranges`` (column: least, largest; None: open).

        Files whose bounds lie outside a range are not read. A name given twice counts twice.
        """
        if not names:
            raise ValueError("no files to read")
        rows = self._named(names)
        wanted = self._schema_of(rows, names)
        kept = rows.select("name", "path", F.xxhash64("schema").alias("digest"), self._may_hold(wanted, ranges or {}).alias("may"))
        files: dict[str, list[tuple[str, int, bool]]] = {}
        for row in kept.orderBy("path").collect():  # a row for each file that is asked for, as any scan lists them
            files.setdefault(row["name"], []).append((row["path"], row["digest"], row["may"]))
        missing = [name for name in names if name not in files]
        if missing:
            raise ValueError(f"not in the manifest: {missing[:5]}")
        texts = {r["digest"]: r["schema"] for r in rows.select(F.xxhash64("schema").alias("digest"), "schema").distinct().collect()}
        known = {digest: T.StructType.fromJson(json.loads(text)) for digest, text in texts.items()}
        schemas = {path: known[digest] for found in files.values() for path, digest, _ in found}
        paths = [path for name in names for path, _, may in files[name] if may]
        scanned = united(self.spark, paths, schemas, wanted) if paths else self.spark.createDataFrame([], wanted)
        for column, (low, high) in (ranges or {}).items():
            scanned = scanned.filter(_within(F.col(quoted(column)), low, high))
        return scanned

    def _schema_of(self, rows: DataFrame, names: Sequence[str]) -> T.StructType:
        first = rows.filter(F.col("name") == names[0]).orderBy("path").select("schema").first()
        if first is None:
            raise ValueError(f"not in the manifest: {[names[0]]}")
        return T.StructType.fromJson(json.loads(first["schema"]))

    def _may_hold(self, wanted: T.StructType, ranges: Mapping[str, Range]) -> Column:
        """Whether a file's bounds meet all ranges; what is not known may be anything."""
        types = {field.name.lower(): field.dataType for field in wanted.fields}
        may = F.lit(True)
        for column, (low, high) in ranges.items():
            if column.lower() not in types:
                raise ValueError(f"there is no column {column}")
            kind = _kind(types[column.lower()])
            if kind is None:
                continue
            bound = F.col("bounds")[column.lower()]
            stored = {"number": "bigint", "date": "date", "time": "timestamp_ntz", "text": "string"}[kind]
            meets = _within(bound["high"].cast(stored), low, None) & _within(bound["low"].cast(stored), None, high)
            # Bounds of another kind are in another order.
            may = may & F.when(bound["kind"] == kind, meets).otherwise(True)
        return may


def _within(column: Column, low: Any, high: Any) -> Column:
    inside = column.isNotNull()
    if low is not None:
        inside = inside & (column >= _literal(low))
    return inside if high is None else inside & (column <= _literal(high))


def _literal(bound: Any) -> Column:
    if isinstance(bound, datetime.datetime) and bound.tzinfo is None:
        return F.lit(str(bound)).cast("timestamp_ntz")
    if isinstance(bound, (int, str, datetime.date)) and not isinstance(bound, datetime.datetime):
        return F.lit(bound)
    raise ValueError("a range needs whole numbers, text, dates or times without a zone")
