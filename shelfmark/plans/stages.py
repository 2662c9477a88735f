"""Stage tables: cuts lineage by writing to the folder in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame


@cache
def _stand_in(master: str) -> str:
    """One temporary folder of this process, on one machine only."""
    if not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='shelfmark-')}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it back. Only on one machine may a temporary folder stand in for an unset setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or _stand_in(spark.sparkContext.master)
    path = f"{base.rstrip('/')}/shelfmark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
