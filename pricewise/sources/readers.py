"""A1-A4: scans of the listing and revision tables, and the result sink.

CSV columns are found by the name in the header of their own file, whatever their
order (files may differ); columns that the schema doesn't know are ignored and a missing
one is an error. Lines with too few or too many cells, or that are no UTF-8, are
kept apart (``scan_csv``). Cells are
read as text and converted with ``try_cast`` / ``try_to_timestamp``, so a bad cell
becomes NULL; ``rejected_cells`` counts them. NaN in double columns becomes NULL,
so downstream only NULL exists (Spark counts NaN as a value and sorts it above all
numbers). Parquet columns that already have the declared type are passed on
untouched, so filters on them reach the scan; the cleaning rules know NaN, and
``clean_listings`` (or ``nan_to_null``) turns it into NULL after filtering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schema import LISTING_SCHEMA, REVISION_SCHEMA


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating-point column as NULL."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def _cell(name: str, kind: T.DataType, timestamp_format: str | None) -> Column:
    """A text cell as ``kind``; NULL if it is not one."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, (T.TimestampType, T.DateType)):
        value = F.try_to_timestamp(text, *([F.lit(timestamp_format)] if timestamp_format else []))
        return value.cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = text.try_cast("double")
        return F.when(~F.isnan(value), value).cast(kind)
    if isinstance(kind, T.IntegralType):
        # "3.0" is the number 3; "3.5" is not a whole number.
        whole = text.try_cast("decimal(38,6)")
        return F.coalesce(text.try_cast(kind), F.when(whole == F.floor(whole), whole.try_cast(kind)))
    return F.col(f"`{name}`").cast(kind)


def _check_columns(raw: DataFrame, schema: T.StructType, what: str) -> None:
    missing = [f.name for f in schema.fields if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{what}: missing column(s) {', '.join(missing)}; found {', '.join(raw.columns)}")


def parse_text(raw: DataFrame, schema: T.StructType, timestamp_format: str | None = None) -> DataFrame:
    """A table of text columns with the columns and types of ``schema``, by name."""
    _check_columns(raw, schema, "text table")
    return raw.select(*[_cell(f.name, f.dataType, timestamp_format).alias(f.name) for f in schema.fields])


def rejected_cells(raw: DataFrame, schema: T.StructType, timestamp_format: str | None = None) -> DataFrame:
    """``column_name, rejected``: how many non-empty cells (other than NaN) of each
    column could not be converted. One aggregate over the text table."""
    _check_columns(raw, schema, "text table")

    def bad(f: T.StructField) -> Column:
        text = F.lower(F.trim(F.col(f"`{f.name}`")))
        given = text.isNotNull() & ~text.isin("", "nan", "null")
        return F.count(F.when(given & _cell(f.name, f.dataType, timestamp_format).isNull(), 1)).alias(f.name)
    counts = raw.agg(*[bad(f) for f in schema.fields])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("rejected"))
                                            for f in schema.fields])))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all cells as text. All files must have the same header."""
    return spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)


MAX_HEADERS = 200                # different headers among the files of one table


def _lines_and_headers(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """``file, line, at`` (place in the file) of every line, and ``file, header, first`` of every
    file, whose header is its first line."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                         F.struct(F.col("_metadata.file_block_start").alias("b"),
                                                  F.monotonically_increasing_id().alias("i")).alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("header"), F.min("at").alias("first"))
    return lines, heads.withColumn("header", F.regexp_replace("header", "^\uFEFF", ""))


def scan_csv(spark: SparkSession, path, schema: T.StructType, timestamp_format: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of all files with the columns and types of ``schema``, and the lines left out:
    ``file, line, reason`` ('not UTF-8' or 'cells'). Quoted cells may hold separators, not line
    breaks. The different headers (at most ``MAX_HEADERS``) reach the driver."""
    lines, by_file = _lines_and_headers(spark, path)
    heads = [r["header"] for r in by_file.select("header").distinct().limit(MAX_HEADERS + 1).collect()]
    lines = lines.join(by_file, "file").filter(F.col("at") > F.col("first"))
    if len(heads) > MAX_HEADERS:
        raise ValueError(f"more than {MAX_HEADERS} different headers under {path}")
    rows, rejected = [], []
    for h in heads:
        names = spark.range(1).select(F.from_csv(F.lit(h), F.lit(", ".join(
            f"c{i} string" for i in range(h.count(",") + 1)))).alias("c")).first()["c"]
        names = [n for n in names if n is not None]
        missing = [f.name for f in schema.fields if f.name not in names]
        if missing:
            raise ValueError(f"{path}: missing column(s) {', '.join(missing)}; found {', '.join(names)}")
        text = ", ".join(f"`{n}` string" for n in names) + ", `_bad` string"
        good = F.is_valid_utf8(F.col("line"))
        cells = F.from_csv(F.when(good, F.col("line")), F.lit(text), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        part = lines.filter((F.col("header") == h) & (F.trim("line") != "")).select("file", "line", good.alias("_utf8"), cells.alias("_c"))
        broken = F.col("_c._bad").isNotNull()
        rows.append(parse_text(part.filter(F.col("_utf8") & ~broken).select("_c.*"), schema, timestamp_format))
        rejected.append(part.filter(~F.col("_utf8") | broken).select(
            "file", F.make_valid_utf8("line").alias("line"), F.when(F.col("_utf8"), "cells").otherwise("not UTF-8").alias("reason")))
    if not heads:
        empty = spark.createDataFrame([], schema)
        return empty, spark.createDataFrame([], "file string, line string, reason string")
    out, left = rows[0], rejected[0]
    for r, x in zip(rows[1:], rejected[1:]):
        out, left = out.unionByName(r), left.unionByName(x)
    return out, left


def _scan(spark: SparkSession, path: str, fmt: str, schema: T.StructType, timestamp_format: str | None) -> DataFrame:
    if fmt == "csv":
        return scan_csv(spark, path, schema, timestamp_format)[0]
    if fmt != "parquet":
        raise ValueError(f"unsupported format {fmt!r}; use 'csv' or 'parquet'")
    df = spark.read.parquet(path)
    _check_columns(df, schema, path)
    types = {f.name: f.dataType for f in df.schema.fields}

    def column(f: T.StructField) -> Column:
        have = types[f.name]
        if have == f.dataType:
            return F.col(f.name)
        if isinstance(have, T.StringType):
            return _cell(f.name, f.dataType, timestamp_format).alias(f.name)
        return F.col(f.name).cast(f.dataType).alias(f.name)
    return df.select(*[column(f) for f in schema.fields])


def read_listings(spark: SparkSession, path: str, fmt: str = "csv",
                  timestamp_format: str | None = None) -> DataFrame:
    """A1/A3: listing table with the declared columns and types."""
    return _scan(spark, path, fmt, LISTING_SCHEMA, timestamp_format)


def read_revisions(spark: SparkSession, path: str, fmt: str = "csv",
                   timestamp_format: str | None = None) -> DataFrame:
    """A2/A3: revision table with the declared columns and types."""
    return _scan(spark, path, fmt, REVISION_SCHEMA, timestamp_format)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, e.g. ``orders`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def write_bucketed(df: DataFrame, table: str, key: str = "listing_id", buckets: int = 256,
                   fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A4: save a table bucketed and sorted by ``key`` in the session catalog.

    Listings, revisions and the modelling table are all joined and grouped by
    ``listing_id``; when they are stored with the same bucket count, later
    joins and aggregations on the key read co-located buckets without a
    shuffle."""
    (df.write.mode(mode).format(fmt).bucketBy(buckets, key).sortBy(key).saveAsTable(table))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                 partition_by: list[str] | None = None) -> None:
    """A4: persist a shown result table (display itself is not built)."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_partitions(df: DataFrame, path: str, partition_by: list[str]) -> DataFrame:
    """A4: replace exactly the partitions that ``df`` has (dynamic overwrite), so writing the
    same rows again changes nothing and other partitions stay. What was written is read
    back and compared with ``df``: columns and types, and the number of rows, counted
    while they were written. Returns the whole stored table."""
    spark = df.sparkSession
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    (counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path))
    columns = [c for c in df.columns if c not in partition_by] + list(partition_by)
    back = spark.read.schema(df.select(*[F.col(f"`{c}`") for c in columns]).schema).parquet(path)
    stored = {f.name: f.dataType for f in spark.read.parquet(path).schema.fields if f.name not in partition_by}
    wanted = {f.name: f.dataType for f in df.schema.fields if f.name not in partition_by}
    keys = df.select(*partition_by).distinct()
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in partition_by]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    n = back.alias("l").join(keys.alias("r"), cond, "left_semi").count()
    if stored != wanted or n != seen.get["rows"]:
        raise RuntimeError(f"{path}: wrote {seen.get['rows']} rows, found {n}; columns {stored}, expected {wanted}")
    return back.select(*[F.col(f"`{c}`") for c in df.columns])
