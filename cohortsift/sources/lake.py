"""Parquet scans: a list of files as one relation, a path, or a named table."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.dialect import register
from cohortsift.functions.sqltext import quoted
from cohortsift.plans.spec import MAIN, TableRef

if TYPE_CHECKING:
    from cohortsift.sources.manifest import Manifest

_PATH_LITERAL = re.compile(r"^'((?:[^']|'')*)'$")
_READ_CALL = re.compile(r"^read_parquet\(\s*\[(.*)\]\s*\)$", re.IGNORECASE | re.DOTALL)
_LIST_ITEM = re.compile(r"'((?:[^']|'')*)'")
_FOOTER_READERS = 16


def scan_files(spark: SparkSession, files: Sequence[str], schema: T.StructType | str | None = None) -> DataFrame:
    """All rows of ``files`` under the first file's columns, matched by name.

    Columns only later files have are left out; a column a later file lacks is
    an error. Files that store the columns with the same types share one scan;
    other types are cast to the first file's. A file named twice counts twice.

    A ``schema`` known beforehand spares the look into every file's footer; then
    a column some file lacks is NULL there.
    """
    if not files:
        raise ValueError("no files to read")
    if schema is not None:
        return spark.read.schema(schema).parquet(*files)
    schemas = _footers(spark, files)
    return united(spark, files, schemas, schemas[files[0]])


def united(
    spark: SparkSession, files: Sequence[str], schemas: Mapping[str, T.StructType], wanted: T.StructType
) -> DataFrame:
    """The rows of files whose schemas are known, under the columns of ``wanted``."""
    groups: dict[tuple[str, ...], list[str]] = {}
    stored: dict[tuple[str, ...], T.StructType] = {}
    for file in files:
        found = _match(file, wanted, schemas[file])
        kinds = tuple(field.dataType.simpleString() for field in found)
        groups.setdefault(kinds, []).append(file)
        stored[kinds] = found
    parts = []
    for kinds, members in groups.items():
        part = spark.read.schema(stored[kinds]).parquet(*members)
        if stored[kinds] != wanted:
            part = part.select(
                *[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in wanted.fields]
            )
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def _footers(spark: SparkSession, files: Sequence[str]) -> dict[str, T.StructType]:
    """The schema each distinct file carries in its footer."""
    distinct = list(dict.fromkeys(files))
    with ThreadPoolExecutor(min(_FOOTER_READERS, len(distinct))) as pool:
        schemas = pool.map(lambda file: spark.read.parquet(file).schema, distinct)
        return dict(zip(distinct, schemas, strict=True))


def _match(file: str, wanted: T.StructType, found: T.StructType) -> T.StructType:
    by_name = {field.name.lower(): field for field in found.fields}
    missing = [f.name for f in wanted.fields if f.name.lower() not in by_name]
    if missing:
        raise ValueError(f"{file} lacks the columns {missing} of the first file")
    return T.StructType([T.StructField(f.name, by_name[f.name.lower()].dataType, True) for f in wanted.fields])


class Lake:
    """Finds the tables a step names: below ``root``, in ``tables`` or the catalog.

    ``schemas`` declares the columns of files by the name they are asked for; of others a
    ``manifest`` knows them, or their footers are read. A root that is not there shows when a
    table below it is read.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        tables: Mapping[str, DataFrame] | None = None,
        schemas: Mapping[str, str] | None = None,
        manifest: Manifest | None = None,
    ) -> None:
        register(spark)
        self.spark = spark
        self.manifest = manifest
        self.root = root
        self.tables = dict(tables or {})
        self.schemas = dict(schemas or {})
        #: Key profiles of the joins so far, by relation and key. An old one costs balance, not rows.
        self.profiles: dict[tuple, object] = {}

    def path(self, name: str) -> str:
        if self.root is None or name.startswith("/") or "://" in name:
            return name
        return f"{self.root.rstrip('/')}/{name}"

    def main(self, files: Sequence[str]) -> DataFrame:
        """The files under review, known as ``main_table``."""
        return self._scan(files).alias(MAIN)

    def table(self, ref: TableRef) -> DataFrame:
        return self._find(ref).alias(ref.alias)

    def _find(self, ref: TableRef) -> DataFrame:
        if ref.name in self.tables:
            return self.tables[ref.name]
        if ref.quoted:
            return self.spark.table(quoted(ref.name))
        literal = _PATH_LITERAL.match(ref.name)
        if literal:
            return self._read(_unquote(literal.group(1)))
        call = _READ_CALL.match(ref.name)
        if call:
            return self._scan([_unquote(f) for f in _LIST_ITEM.findall(call.group(1))])
        return self.spark.table(ref.name)

    def _read(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(self.schemas[name])
        return reader.parquet(self.path(name))

    def _scan(self, names: Sequence[str]) -> DataFrame:
        declared = list(dict.fromkeys(self.schemas.get(name) for name in names))
        if len(declared) > 1 and None not in declared:
            by_schema = [[name for name in names if self.schemas[name] == schema] for schema in declared]
            parts = [self._scan(group) for group in by_schema]
            first = self._scan(names[:1]).schema
            same = [p.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in first.fields]) for p in parts]
            return reduce(DataFrame.unionByName, same)
        schema = declared[0] if len(declared) == 1 else None
        files = [self.path(name) for name in names]
        if schema is None and self.manifest is not None:
            return self.manifest.scan(files)
        return scan_files(self.spark, files, schema)


def _unquote(text: str) -> str:
    return text.replace("''", "'")
