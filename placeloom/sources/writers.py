"""Writers: tables, incremental overwrite, versioned publication, exports and retention. Paths go through Hadoop's file API."""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p, _ = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p, jvm = _fs(spark, old)
    if not fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"can't rename {old} to {new}")


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, p, _ = _fs(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def codes_as_json(df: DataFrame, suffix: str = "_codes") -> DataFrame:
    """Columns of codes as JSON text, for stores without arrays."""
    return df.withColumns({c: F.to_json(c) for c, kind in df.dtypes if c.endswith(suffix) and kind.startswith(("array", "map", "struct"))})


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Delete and insert by key: the partitions that ``df`` has are replaced, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


#: A stamp of a published version: letters, digits and hyphens, so a longer table name is never taken for one.
STAMP = re.compile(r"[A-Za-z0-9-]+")


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """Paths of the published versions of exactly this table, oldest first."""
    own = [p for p in listing(spark, root) if p.rsplit("/", 1)[1].startswith(f"{name}__") and STAMP.fullmatch(p.rsplit("/", 1)[1].removeprefix(f"{name}__"))]
    return sorted(own)


def publish(df: DataFrame, root: str, name: str, stamp: str, validate=None, keep: int = 2) -> DataFrame:
    """Blue/green: writes ``root/name__stamp``, validates it, points the view ``name_in_use`` at it, and removes older versions of
    this table. What was just published stays, whatever its stamp."""
    if not STAMP.fullmatch(stamp) or "__" in name:
        raise ValueError(f"not a table and a stamp: {name}, {stamp}")
    spark = df.sparkSession
    path = f"{root}/{name}__{stamp}"
    df.write.mode("overwrite").parquet(path)
    written = spark.read.parquet(path)
    if validate is not None and not validate(written):
        delete(spark, path)
        raise ValueError(f"{name}__{stamp} is not valid; the view stays as it is")
    written.createOrReplaceTempView(f"{name}_in_use")
    others = [p for p in versions(spark, root, name) if p.rsplit("/", 1)[1] != f"{name}__{stamp}"]
    for old in others[: max(0, len(others) - (keep - 1))]:
        delete(spark, old)
    return written


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file whole: a new one is written beside it and renamed over it."""
    fs, p, jvm = _fs(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kinds = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, p, kinds)


def _read_text(spark: SparkSession, path: str) -> str | None:
    return spark.read.text(path, wholetext=True).first()[0].strip() if exists(spark, path) else None


def swap(df: DataFrame, path: str) -> None:
    """Writes the next version below ``path`` and then moves the pointer ``path/CURRENT`` to it in one rename. Readers (``current``)
    see the old table whole or the new one; a failure before the rename changes nothing for them. The version before the
    last stays for readers that are at work."""
    spark = df.sparkSession
    pointer, version = f"{path}/CURRENT", f"v-{uuid.uuid4().hex}"
    before = _read_text(spark, pointer)
    df.write.parquet(f"{path}/{version}")
    _write_text(spark, pointer, version)
    for old in listing(spark, path):
        if old.rsplit("/", 1)[1].startswith("v-") and old.rsplit("/", 1)[1] not in (version, before):
            delete(spark, old)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``swap`` put in place last."""
    version = _read_text(spark, f"{path}/CURRENT")
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{version}")


def export_excel(df: DataFrame, path: str, order: list[str]) -> int:
    """An export for people: rows in order, fetched partition by partition and streamed to one sheet; needs an Excel package."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("writing Excel needs openpyxl") from e
    book = Workbook(write_only=True)
    sheet = book.create_sheet()
    sheet.append(df.columns)
    rows = 0
    for r in df.orderBy(*order).toLocalIterator():
        sheet.append([None if v is None else str(v) for v in r])
        rows += 1
    book.save(path)
    return rows


def export_csv(df: DataFrame, root: str, name: str, stamp: str) -> tuple[str, str]:
    """A stamped and a stable copy with a header, one file each: an export for people, not a table."""
    paths = f"{root}/{name}_{stamp}", f"{root}/{name}"
    for p in paths:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(p)
    return paths


def retain(spark: SparkSession, root: str, name: str, now: datetime, days: int = 30) -> list[str]:
    """Deletes stamped exports older than ``days``; the stable name stays."""
    gone = []
    for p in listing(spark, root):
        stamp = p.rsplit("/", 1)[1].removeprefix(f"{name}_")
        if len(stamp) == 8 and stamp.isdigit() and datetime.strptime(stamp, "%Y%m%d") < now - timedelta(days=days):
            delete(spark, p)
            gone.append(p)
    return gone


def copy_tables(spark: SparkSession, source: str, target: str, tables: list[str], schema_only: bool = False) -> None:
    """Dump and restore of a table subset."""
    for t in tables:
        df = spark.read.parquet(f"{source}/{t}")
        (df.limit(0) if schema_only else df).write.mode("overwrite").parquet(f"{target}/{t}")


def schema_differences(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns that differ in name or type, for a check before publication."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    return sorted(f"{c}: {x.get(c)} / {y.get(c)}" for c in x.keys() | y.keys() if x.get(c) != y.get(c))


def delete_insert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The next state of an incremental table as a frame: fresh rows, and old rows of other keys."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True).select(*[F.col(c) for c in fresh.columns])
