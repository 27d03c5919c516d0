"""Written tables in the folder that all executors share, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a side that may be broadcast after they have been summed.
BROADCAST_BYTES = 8 << 20
#: Rows that a task sorts, about.
SORT_ROWS = 1 << 18


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="feedloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this process where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return base.rstrip("/") + "/feedloom"


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read back: it cuts lineage for good and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already written) with a broadcast hint if its values take at most ``limit`` bytes; else a shuffle join."""
    wide = [F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.octet_length(F.to_json(f.name)) if f.dataType.typeName() in ("array", "map", "struct") else F.lit(8) for f in df.schema]
    size = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in ranges of about SORT_ROWS rows, a task for each, whatever the number of shuffle partitions. It is counted first."""
    return df.repartitionByRange(max(1, -(-df.count() // SORT_ROWS)), *keys).sortWithinPartitions(*keys)
