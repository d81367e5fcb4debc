"""Parquet tables with typed schemas, units, quality rules and file metadata."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.filters import Filter, filter_rows
from ..functions.random import sample as row_sample
from ..operators.sorting import sort_by

#: Names of the plain types in a schema file.
TYPES = {"int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(), "time": T.LongType()}

log = logging.getLogger(__name__)


@dataclass
class FieldSpec:
    """A column: its type, unit, width if a vector, and quality rules (least, greatest, value that stands for missing)."""

    name: str
    data_type: str
    unit: str | None = None
    info: str | None = None
    ucd: str | None = None
    col_size: int = 1
    minimum: float | None = None
    maximum: float | None = None
    miss: str | None = None
    protected: bool = False

    def spark(self) -> T.StructField:
        if self.data_type not in TYPES:
            raise ValueError(f"{self.name}: unknown type {self.data_type!r}")
        kind = TYPES[self.data_type]
        notes = {k: v for k, v in (("unit", self.unit), ("info", self.info), ("ucd", self.ucd)) if v}
        if self.data_type == "time":
            notes["logical"] = "time"
        if self.col_size > 1:
            kind, notes = T.ArrayType(kind), notes | {"width": self.col_size}
        return T.StructField(self.name, kind, not self.protected, notes)


@dataclass
class TableSpec:
    """A table's columns and metadata, with renamings, a filter and an order that apply on reading."""

    fields: list[FieldSpec] = field(default_factory=list)
    metadata: dict[str, object] = field(default_factory=dict)
    remap: dict[str, str] = field(default_factory=dict)
    filters: list[str] = field(default_factory=list)
    sort: list[str] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([f.spark() for f in self.fields])

    def add_field(self, name: str, data_type: str, **more) -> TableSpec:
        if any(f.name == name for f in self.fields):
            raise ValueError(f"{name} is there already")
        self.fields.append(FieldSpec(name, data_type, **more))
        self.fields[-1].spark()
        return self

    @staticmethod
    def derive(df: DataFrame) -> TableSpec:
        """The spec of a frame's plain and vector columns."""
        names = {v: k for k, v in TYPES.items() if k != "time"}
        out = TableSpec()
        for f in df.schema:
            kind, width = f.dataType, f.metadata.get("width", 1)
            if isinstance(kind, T.ArrayType) and "width" in f.metadata:
                kind = kind.elementType
            if kind not in names:
                raise TypeError(f"{f.name} has no plain type")
            out.fields.append(FieldSpec(f.name, names[kind], f.metadata.get("unit"), f.metadata.get("info"), f.metadata.get("ucd"), width, protected=not f.nullable))
        return out

    @staticmethod
    def parse(text: str) -> TableSpec:
        """From the indented text form: top-level keys with values, ``fields:`` as a list of keys, ``extra:`` with remap, filter and sort."""
        tree = _tree(text)
        out = TableSpec(metadata={k: v for k, v in tree.items() if k not in ("fields", "extra")})
        for f in tree.get("fields") or []:
            qc = f.get("qc") or {}
            out.add_field(f["name"], f["data_type"], unit=f.get("unit"), info=f.get("info"), ucd=f.get("ucd"), col_size=int(f.get("col_size") or f.get("array_size") or 1), minimum=_number(qc.get("min")), maximum=_number(qc.get("max")), miss=qc.get("miss"))
        extra = tree.get("extra") or {}
        aslist = lambda x: [] if x is None else x if isinstance(x, list) else [x]
        for pair in aslist(extra.get("remap")):
            out.remap.update(pair if isinstance(pair, dict) else dict([tuple(p.strip() for p in pair.split(":", 1))]))
        out.filters, out.sort = aslist(extra.get("filter")), aslist(extra.get("sort"))
        for f in out.fields:
            f.protected = f.name in aslist(extra.get("protected_cols"))
        return out

    def emit(self) -> str:
        lines = [f"{k}: {json.dumps(v) if isinstance(v, str) else v}" for k, v in self.metadata.items()] + ["fields:"]
        for f in self.fields:
            lines.append(f"- name: {f.name}")
            lines += [f"  {k}: {v}" for k, v in (("data_type", f.data_type), ("unit", f.unit), ("info", f.info), ("ucd", f.ucd), ("col_size", f.col_size if f.col_size > 1 else None)) if v is not None]
            rules = [(k, v) for k, v in (("min", f.minimum), ("max", f.maximum), ("miss", f.miss)) if v is not None]
            if rules:
                lines += ["  qc:", *[f"    {k}: {v}" for k, v in rules]]
        return "\n".join(lines) + "\n"


def _number(x) -> float | None:
    return None if x is None else float(x)


def _value(text: str):
    text = text.strip()
    if text[:1] == '"' and text[-1:] == '"' or text[:1] == "'" and text[-1:] == "'":
        return text[1:-1]
    return text or None


def _tree(text: str):
    """Mappings, lists and scalars of an indented text; everything after # is a comment unless quoted."""
    rows = []
    for raw in text.splitlines():
        line = raw if '"' in raw else raw.split(" #")[0]
        if line.strip() and not line.lstrip().startswith(("#", "---")):
            rows.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int):
        if at >= len(rows):
            return None, at
        if rows[at][1].startswith("- ") or rows[at][1] == "-":
            out = []
            while at < len(rows) and rows[at][0] == depth and rows[at][1].startswith("-"):
                body = rows[at][1][1:].strip()
                if ":" in body and not body.startswith('"'):
                    inner = depth + len(rows[at][1]) - len(body)
                    rows[at] = (inner, body)
                    value, at = block(at, inner)
                else:
                    value, at = _value(body), at + 1
                out.append(value)
            return out, at
        mapping = {}
        while at < len(rows) and rows[at][0] == depth and not rows[at][1].startswith("- "):
            key, _, rest = rows[at][1].partition(":")
            at += 1
            if rest.strip():
                mapping[key.strip()] = _value(rest)
            elif at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- ")):
                mapping[key.strip()], at = block(at, rows[at][0])
            else:
                mapping[key.strip()] = None
        return mapping, at

    return block(0, rows[0][0])[0] if rows else {}


class QualityError(ValueError):
    """Rows that break a quality rule."""


def quality(df: DataFrame, spec: TableSpec) -> dict[str, int]:
    """Rows out of range or null in a protected column, by column; one pass. A NaN is out of range."""
    tests = {}
    for f in spec.fields:
        if f.name not in df.columns:
            continue
        c, bad = F.col(f"`{f.name}`"), F.lit(False)
        if f.minimum is not None or f.maximum is not None:
            if isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)):
                bad = bad | F.isnan(c)
            if f.minimum is not None:
                bad = bad | (c < f.minimum)
            if f.maximum is not None:
                bad = bad | (c > f.maximum)
            if f.miss is not None:
                bad = bad & (c.cast("string") != F.lit(str(f.miss)))
        if f.protected:
            bad = bad | c.isNull()
        tests[f.name] = F.count_if(F.coalesce(bad, F.lit(False)))
    if not tests:
        return {}
    row = df.agg(*[t.alias(n) for n, t in tests.items()]).first()
    return {n: row[n] for n in tests if row[n]}


def read_table(
    spark: SparkSession, path: str, *, columns: Sequence[str] | None = None, rule: str | Filter | None = None, sort: str | Sequence[str] | None = None, rows: tuple[int, int] | None = None,
    fraction: float | None = None, seed: int = 0, row_index: str | None = None, spec: TableSpec | None = None, qc: str = "off",
) -> DataFrame:
    """A table with its transforms in their fixed order: sample, quality, filter, sort. Row numbers are 1-based and physical.

    Filters and chosen columns reach the scan; a sample depends only on seed and row, so it commutes with the filter.
    """
    if qc not in ("off", "soft", "hard"):
        raise ValueError("qc is off, soft or hard")
    df = spark.read.parquet(path)
    for old, new in (spec.remap if spec else {}).items():
        df = df.withColumnRenamed(old, new)
    number = row_index or ("__row" if rows or fraction is not None else None)
    if number:
        df = df.select("*", (F.col("_metadata.row_index") + 1).alias(number))
    if rows:
        df = df.where(F.col(number).between(*rows))
    if fraction is not None:
        df = row_sample(df, number, fraction, seed)
    if spec and qc != "off":
        broken = quality(df, spec)
        if broken and qc == "hard":
            raise QualityError(f"rows break the rules: {broken}")
        if broken:
            log.warning("rows break the rules: %s", broken)
    for r in [*(spec.filters if spec else []), *([rule] if rule else [])]:
        df = filter_rows(df, r)
    order = sort or (spec.sort if spec and spec.sort else None)
    if order:
        df = sort_by(df, order, number)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in [*columns, *([row_index] if row_index else [])]])
    return df.drop("__row")


def conform(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The spec's columns in its order and types, checked; a missing column is null unless it is protected."""
    from ..operators.table import cast

    for f in spec.fields:
        target = f.spark()
        if f.name not in df.columns:
            if f.protected:
                raise ValueError(f"{f.name} is protected and missing")
            df = df.withColumn(f.name, F.lit(None).cast(target.dataType))
        elif f.col_size > 1:
            fits = F.col(f"`{f.name}`").isNull() | (F.size(f"`{f.name}`") == f.col_size)
            df = df.withColumn(f.name, F.when(fits, F.col(f"`{f.name}`")).otherwise(F.raise_error(F.lit(f"{f.name} has rows of another width")).cast(target.dataType)).cast(target.dataType))
        elif df.schema[f.name].dataType != target.dataType:
            df = cast(df, f.name, target.dataType) if isinstance(target.dataType, T.NumericType) and isinstance(df.schema[f.name].dataType, T.NumericType) else df.withColumn(f.name, F.col(f"`{f.name}`").cast(target.dataType))
    return df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.spark().metadata) for f in spec.fields])


def write_table(df: DataFrame, path: str, *, spec: TableSpec | None = None, mask: str | Filter | None = None, mode: str = "errorifexists", compression: str = "zstd", row_group_bytes: int | None = None, metadata: Mapping[str, object] | None = None, col_map: Mapping[str, str] | None = None) -> None:
    """The rows as Parquet; the spec's types are enforced, its quality rules only warn. ``col_map`` gives columns other names in the file."""
    if mask is not None:
        df = filter_rows(df, mask)
    if spec:
        df = conform(df, spec)
        if broken := quality(df, spec):
            log.warning("rows break the rules: %s", broken)
    if col_map:
        if missing := [c for c in col_map if c not in df.columns]:
            raise KeyError(f"missing columns: {', '.join(missing)}")
        df = df.withColumnsRenamed(dict(col_map))
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("two columns would have one name")
    w = df.write.mode(mode).option("compression", compression)
    if row_group_bytes:
        w = w.option("parquet.block.size", row_group_bytes)
    w.parquet(path)
    notes = {**(spec.metadata if spec else {}), **(metadata or {})}
    if notes:
        spark = df.sparkSession
        spark.createDataFrame([(k, json.dumps(v)) for k, v in notes.items()], "key string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/_table_metadata")


def read_metadata(spark: SparkSession, path: str, key: str | None = None, default=None):
    """The table's metadata, or one value of it."""
    try:
        rows = spark.read.schema("key string, value string").json(f"{path}/_table_metadata").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    found = {r["key"]: json.loads(r["value"]) for r in rows}
    return found if key is None else found.get(key, default)


def _footers(spark: SparkSession, path: str):
    """(file, footer) of each file, in order of names, read one at a time by the file system that Spark reads the table by."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in sorted(spark.read.parquet(path).inputFiles()):
        place = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(place, conf))
        try:
            yield name, reader.getFooter()
        finally:
            reader.close()


def row_group_bounds(spark: SparkSession, path: str) -> DataFrame:
    """``file, row_group, first_row, last_row, bytes``: a file's row groups from 1, rows by their physical number in the file.

    Only footers are read. An empty row group has a last row before its first.
    """
    rows = []
    for name, footer in _footers(spark, path):
        first = 1
        for i, block in enumerate(footer.getBlocks()):
            n = block.getRowCount()
            rows.append((name, i + 1, first, first + n - 1, block.getTotalByteSize()))
            first += n
    return spark.createDataFrame(rows, "file string, row_group int, first_row long, last_row long, bytes long")


def read_row_group(spark: SparkSession, path: str, row_group: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of one row group of a table of a single file, with the physical row numbers as ``row``."""
    bounds = row_group_bounds(spark, path).where(F.col("row_group") == row_group).collect()
    if len(bounds) != 1:
        raise ValueError(f"the table has {len(bounds)} row groups of number {row_group}")
    return read_table(spark, path, columns=columns, rows=(bounds[0]["first_row"], bounds[0]["last_row"]), row_index="row")


def footer_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """The key-value pairs of the files' footers, those of writers other than this library's too; of two values of a key the first file's stays."""
    found: dict[str, str] = {}
    for _, footer in _footers(spark, path):
        for key, value in dict(footer.getFileMetaData().getKeyValueMetaData()).items():
            found.setdefault(key, value)
    return found


def columns_of(df: DataFrame) -> list[tuple[str, str, int | None, str | None]]:
    """(name, type, width, unit) of every column."""
    return [(f.name, f.dataType.simpleString(), f.metadata.get("width"), f.metadata.get("unit")) for f in df.schema]


def has_nulls(df: DataFrame) -> dict[str, bool]:
    row = df.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first()
    return {c: bool(row[c]) for c in df.columns}


def list_width(df: DataFrame, name: str) -> int | None:
    """The one width of a list column's rows, or None if they differ."""
    lo, hi = df.where(F.col(name).isNotNull()).agg(F.min(F.size(name)), F.max(F.size(name))).first()
    return lo if lo == hi else None


def map_value(name: str, key: str, occurrence: int = 1):
    """A map's value under a key; keys may repeat, and the n-th occurrence can be asked for."""
    entries = F.filter(F.map_entries(name), lambda e: e["key"] == key)
    return F.get(entries, F.lit(occurrence - 1))["value"]
