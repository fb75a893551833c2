"""Tables written to the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: list[str] = []
_STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. A temporary folder stands in only on a local master, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _LOCAL_SHARED:
            _LOCAL_SHARED.append("file://" + tempfile.mkdtemp(prefix="placeloom-shared-"))
        base = _LOCAL_SHARED[0]
    return base


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage, so that a lost executor costs a re-read and not a recomputation, and lets several consumers share one
    computation. The files stay until they are released, because the plan that reads them is lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/placeloom-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> list[str]:
    """Paths of the tables that this process staged and hasn't released, oldest first."""
    return list(_STAGED)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged tables, once whatever read them has been written elsewhere."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        if path in _STAGED:
            _STAGED.remove(path)


def reads(df: DataFrame, path: str) -> bool:
    """Whether the plan of ``df`` reads the staged table at ``path``; true where the plan doesn't tell (cached or unknown relations)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            if any(path.rstrip("/").endswith(roots.apply(j).toUri().getPath()) for j in range(roots.size())):
                return True
        elif kind not in ("LocalRelation", "OneRowRelation", "OneRowRelation$", "Range"):
            return True
    return False
