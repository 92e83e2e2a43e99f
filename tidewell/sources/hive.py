"""Parquet datasets whose files do not agree on their schema."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import Table


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob has anything, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def data_files(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """All data files under a root, in order of modification time, then name; files and folders whose name begins with _ or . are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    walk, out, lead = fs.listFiles(p, True), [], len(fs.makeQualified(p).toString())
    while walk.hasNext():
        status = walk.next()
        path = status.getPath().toString()
        if path.endswith(suffix) and not any(x.startswith(("_", ".")) for x in path[lead:].split("/")):
            out.append((status.getModificationTime(), path))
    return [path for _, path in sorted(out)]


def canonical(df: DataFrame, table: Table, fill: bool = True) -> DataFrame:
    """The table's columns in their types: values that do not parse and missing columns are null, then (fill) the defaults.

    Numbers that have become NaN count as missing. Partition columns stay if the frame has them.
    """
    have = {c.lower(): c for c in df.columns}
    out: list[Column] = []
    for name, kind in {**table.columns, **{p: "string" for p in table.partitions if p in have}}.items():
        c = F.expr(f"try_cast(`{have[name]}` AS {kind})") if name in have else F.lit(None).cast(kind)
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c), c)
        default = table.defaults.get(name)
        out.append((F.coalesce(c, F.lit(default).cast(kind)) if fill and default is not None else c).alias(name))
    provenance = [c for c in df.columns if c.startswith("_src_")]
    return df.select(*out, *provenance)


def provenance(df: DataFrame) -> DataFrame:
    """Adds where each row comes from: _src_mtime, _src_file and _src_row, which order rows from the oldest to the latest writer."""
    return df.select("*", F.col("_metadata.file_modification_time").alias("_src_mtime"), F.col("_metadata.file_name").alias("_src_file"), F.col("_metadata.row_index").alias("_src_row"))


def footers(spark: SparkSession, paths: list[str]) -> list[tuple[str, str | None]]:
    """Each file with the schema in its footer as text (None: unreadable), read by the executors, a few bytes a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = []
            for path in batch.column(0).to_pylist():
                try:
                    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))
                    shapes.append(pq.read_schema(inner, filesystem=fs).remove_metadata().to_string())
                except (pa.ArrowInvalid, OSError):
                    shapes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shapes, pa.string())], names=["path", "shape"])

    if not paths:
        return []
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), 4 * spark.sparkContext.defaultParallelism))
    shapes = {r.path: r.shape for r in listed.mapInArrow(run, "path string, shape string").collect()}
    return [(p, shapes[p]) for p in paths]


def read_drifting(spark: SparkSession, root: str, table: Table, track: bool = False) -> DataFrame:
    """Every readable file under root in the table's schema, whatever types its own columns have.

    Files are grouped by the schema in their footers and each group is read with its own schema, then cast and
    united by name; only footers are read beforehand. Files without a readable footer are skipped. Partition columns come
    from the path, also where a file has its own copies. track adds the provenance columns.
    """
    groups: dict[str, list[str]] = defaultdict(list)
    for path, shape in footers(spark, data_files(spark, root)):
        if shape is not None:
            groups[shape].append(path)
    frames = []
    for paths in groups.values():
        df = spark.read.option("basePath", root).option("ignoreCorruptFiles", "true").parquet(*paths)
        if track:
            df = provenance(df)
        for p in table.partitions:
            if p in df.columns:
                df = df.withColumn(p, F.coalesce(F.url_decode(F.nullif(F.regexp_extract(F.input_file_name(), rf"/{p}=([^/]+)/", 1), F.lit(""))), F.col(p).cast("string")))
        frames.append(canonical(df, table, fill=False))
    if not frames:
        empty = spark.createDataFrame([], table.schema)
        return empty.select("*", F.lit(None).cast("timestamp").alias("_src_mtime"), F.lit("").alias("_src_file"), F.lit(0).cast("bigint").alias("_src_row")) if track else empty
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_table(spark: SparkSession, root: str, table: Table) -> DataFrame:
    """A table whose files agree: one scan with the declared schema, so that partition filters and predicates reach the files. An absent path is an empty table."""
    if not data_files(spark, root):
        return spark.createDataFrame([], table.schema)
    return spark.read.schema(table.schema).option("ignoreCorruptFiles", "true").parquet(root)


Filter = tuple[str, str, object]


def dnf(filters: list[list[Filter]] | list[Filter] | None) -> Column | None:
    """A condition from a disjunction of conjunctions of (column, operator, value); a flat list is one conjunction."""
    if not filters:
        return None
    groups = [filters] if isinstance(filters[0], tuple) else filters
    test = {
        "=": lambda c, v: c == v,
        "==": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(list(v)),
        "not in": lambda c, v: ~c.isin(list(v)),
    }
    return reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, (test[op](F.col(c), v) for c, op, v in g)) for g in groups))
