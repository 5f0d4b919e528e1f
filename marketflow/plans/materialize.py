"""Lineage cuts: written Parquet in the shared folder that ``spark.checkpoint.dir`` names.

A lost executor does not lose the files, and later passes prune columns and
push filters into the scan. A folder made for a local session is removed when
the process ends (see ``session.checkpoint_dir``); on a cluster the folder's owner
sets how long its files stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from marketflow.session import scratch_path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a fresh path in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
