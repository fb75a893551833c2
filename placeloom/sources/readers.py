"""Readers. Formats that Spark reads are read by Spark, with explicit schemas; edge formats are gated behind their import."""

from __future__ import annotations

import csv
import gzip
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def csv_text(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", encoding: str = "UTF-8", bad: str = "PERMISSIVE") -> DataFrame:
    """All columns as text, as the registers want it; ``.gz`` is read as it is. Bad lines follow ``bad`` (PERMISSIVE, DROPMALFORMED, FAILFAST)."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", bad).option("inferSchema", False)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def utf16_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """UTF-16-LE needs whole files per task, because lines can't be found in the middle of one."""
    return spark.read.option("header", True).option("sep", sep).option("encoding", "UTF-16LE").option("multiLine", True).csv(path)


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: geometry type, coordinates as JSON text, properties as a map."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.geometry.type", "f.geometry.coordinates", "f.properties")


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, partitions: int = 1, fetch: int = 10_000) -> DataFrame:
    """A foreign table, read in ranges of ``key`` if one is given."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch)}
    if key is not None:
        options |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**options).load()


def excel(spark: SparkSession, path: str) -> DataFrame:
    """An edge connector for small workbooks, read on the driver; needs an Excel package."""
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path, dtype=str))
    except ImportError as e:
        raise RuntimeError("reading Excel needs openpyxl") from e


def sampled(df: DataFrame, share: float = 0.1, seed: int = 42, on: bool = True) -> DataFrame:
    """A sample for development runs."""
    return df.sample(share, seed) if on else df


def latest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the highest keys: a top-k, not a full sort."""
    return df.orderBy(F.desc(key)).limit(n)


def literal_values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


SUBSTITUTION = re.compile(r"^s/((?:[^/\\]|\\.)+)/((?:[^/\\]|\\.)*)/g$")


def literal_substitution(c: Column, rule: str) -> Column:
    """Applies a validated ``s/a/b/g`` rule as a literal replacement; anything else raises."""
    m = SUBSTITUTION.match(rule)
    if not m or re.search(r"[;&|`$<>\n]", rule):
        raise ValueError(f"not a literal substitution: {rule}")
    plain = lambda s: re.sub(r"\\(.)", r"\1", s)
    return F.replace(c, F.lit(plain(m[1])), F.lit(plain(m[2])))


def align(df: DataFrame, columns: list[str]) -> DataFrame:
    """The expected columns in order, missing ones empty, others dropped, all as text."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def zipped_csv(spark: SparkSession, path: str, columns: list[str], member: str = "", sep: str = ";", encoding: str = "UTF-8", substitutions: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """CSV files inside zip archives, all columns as text: one task per archive, which streams its members line by line.

    ``member`` is part of the names wanted; ``encoding`` may be ISO-8859-1 or UTF-16-LE; bytes that can't be decoded are replaced;
    ``substitutions`` mend corrupted text literally; the first line names the columns; lines with another number of fields are left out.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        if member in name and not name.endswith("/"):
                            with archive.open(name) as raw:
                                yield from _csv_batches(raw, columns, sep, encoding, substitutions)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def gzipped_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8", substitutions: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """CSV in gzip files, decoded and mended as by ``zipped_csv``; nothing is unpacked to disk."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with gzip.open(io.BytesIO(content.as_py())) as raw:
                    yield from _csv_batches(raw, columns, sep, encoding, substitutions)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def _csv_batches(raw, columns: list[str], sep: str, encoding: str, substitutions: tuple[tuple[str, str], ...], size: int = 5000) -> Iterator[pa.RecordBatch]:
    def mended() -> Iterator[str]:
        for line in io.TextIOWrapper(raw, encoding, errors="replace", newline=""):
            for a, b in substitutions:
                line = line.replace(a, b)
            yield line.lstrip("\ufeff")

    lines = csv.reader(mended(), delimiter=sep)
    head = next(lines, [])
    at, held = [head.index(c) if c in head else None for c in columns], []
    for line in lines:
        if len(line) == len(head):
            held.append([None if i is None or line[i] == "" else line[i] for i in at])
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], columns)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], columns)


def parsed_codes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """JSON text of a store back as columns of the given types; text that can't be parsed is null."""
    return df.withColumns({c: F.from_json(F.col(c), kind) for c, kind in kinds.items()})


class _Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class PagedReader(DataSourceReader):
    """Pages of a JSON endpoint. ``fetch`` (url to text) is a pickled function, so tests and offline runs inject it."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.options, self.schema = options, schema

    def _fetch(self, url: str):
        import importlib

        module, _, name = self.options["fetch"].partition(":")
        return json.loads(getattr(importlib.import_module(module), name)(url))

    def partitions(self) -> list[InputPartition]:
        url, mode = self.options["url"], self.options.get("mode", "single")
        if mode != "numbered":
            return [_Page(url)]
        first = self._fetch(f"{url}?page=1")
        pages = -(-int(first["total"]) // max(1, len(first["data"])))
        return [_Page(f"{url}?page={i}") for i in range(1, pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url: str | None = partition.url
        while url:
            body = self._fetch(url)
            rows = body if isinstance(body, list) else body["data"]
            for r in rows:
                yield tuple(None if r.get(f.name) is None else str(r[f.name]) for f in self.schema)
            url = body.get("next") if isinstance(body, dict) and self.options.get("mode") == "cursor" else None


class PagedSource(DataSource):
    """``spark.read.format("paged_json")``: one task per numbered page, or one that follows cursors."""

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(dict(self.options), schema)


def paged(spark: SparkSession, url: str, columns: str, fetch: str, mode: str = "single") -> DataFrame:
    """``mode``: single, cursor (``next`` links) or numbered (a total count); ``fetch`` is ``module:function``."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").option("url", url).option("columns", columns).option("fetch", fetch).option("mode", mode).load()


def _endpoint(mode: str) -> Callable[..., DataFrame]:
    return lambda spark, url, **how: paged(spark, url, mode=mode, **how)


#: Endpoint dispatch: the first pattern that a url matches names its reader. Files go by their ending; of JSON endpoints those that
#: ``cursors`` or ``numbered`` name are read in pages, and others without a query string in one block.
DISPATCH: list[tuple[str, Callable[..., DataFrame]]] = [(r"\.xlsx?$", excel), (r"\.geojson$", geojson), (r"\.zip$", zipped_csv), (r"\.csv\.gz$", gzipped_csv), (r"\.csv$", csv_text), (r"\.parquet$", parquet), (r"^https?://[^?]+$", _endpoint("single"))]


def by_url(spark: SparkSession, url: str, cursors: tuple[str, ...] = (), numbered: tuple[str, ...] = (), **how) -> DataFrame:
    """The frame behind a url, by the reader that its shape names. ``cursors`` and ``numbered`` are hosts whose JSON endpoints follow
    next links or count pages; an unknown shape raises."""
    host = re.sub(r"^https?://([^/:?]+).*$", r"\1", url)
    for hosts, mode in ((cursors, "cursor"), (numbered, "numbered")):
        if any(host == h or host.endswith(f".{h}") for h in hosts):
            return paged(spark, url, mode=mode, **how)
    for pattern, reader in DISPATCH:
        if re.search(pattern, url):
            return reader(spark, url, **how)
    raise ValueError(f"no reader for {url}")
