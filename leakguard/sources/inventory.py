"""File inventory: listing a tree across the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakguard.operators.skew import materialize

_ENTRY = "path string, size long, is_dir boolean"


def _children(directories: DataFrame) -> DataFrame:
    """Entries directly inside each directory; names and lengths only."""

    def list_each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path in batch["path"]:
                files, inner = fs.FileSystem.from_uri(path)
                try:
                    found = files.get_file_info(fs.FileSelector(inner))
                except OSError:
                    continue  # unreadable: known as a directory, contents unknown
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    # Arrow drops the scheme; keep paths as the roots spell them
                    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
                    yield pd.DataFrame(
                        {
                            "path": [prefix + i.path for i in part],
                            "size": pd.array(
                                [i.size if i.type == fs.FileType.File else None for i in part],
                                dtype="Int64",
                            ),
                            "is_dir": [i.type == fs.FileType.Directory for i in part],
                        }
                    )

    return directories.select("path").repartition("path").mapInPandas(list_each, _ENTRY)


def scan_inventory(spark: SparkSession, roots: list[str], scanned_at) -> DataFrame:
    """``path, size, is_dir, scanned_at`` of everything below ``roots``.

    Goes down level by level; the directories of a level are listed in parallel.
    Paths may be local or any URI that Arrow's file systems know.
    """
    level = spark.createDataFrame([(r.rstrip("/"), None, True) for r in roots], _ENTRY)
    found = level
    while True:
        level = materialize(_children(level.filter("is_dir")))
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.withColumn("scanned_at", F.lit(scanned_at).cast("timestamp"))


def routes_frame(spark: SparkSession, routes: dict[str, str]) -> DataFrame:
    """Configured routes ``{tag: root}`` as a frame."""
    return spark.createDataFrame(list(routes.items()), "tag string, root string")
