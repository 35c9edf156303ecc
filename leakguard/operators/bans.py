"""Ban records: numbering, listing, manual entries and the ban table."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from leakguard.functions.net import parse_prefix
from leakguard.operators.skew import materialize, number_rows
from leakguard.schemas import BAN_RECORD, MANUAL_BAN

_STORED = T.StructType([*BAN_RECORD.fields, T.StructField("batch", T.StringType())])
_MARK = "first_id long, next_id long"


def _at(now: datetime | str | Column) -> Column:
    return (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")


def unexpired(bans: DataFrame, now) -> DataFrame:
    return bans.filter(F.col("expires_at") > _at(now))


def valid_prefixes(bans: DataFrame) -> DataFrame:
    """Drop records whose prefix does not parse."""
    return bans.filter(parse_prefix("prefix").isNotNull())


def count_invalid(bans: DataFrame) -> DataFrame:
    """One row: how many records ``valid_prefixes`` leaves out."""
    return bans.agg(F.count_if(parse_prefix("prefix").isNull()).alias("invalid"))


def active_bans(bans: DataFrame, now) -> DataFrame:
    return valid_prefixes(unexpired(bans, now))


def without_deleted(bans: DataFrame, deleted_ids: DataFrame) -> DataFrame:
    """Leave out deleted records; only positive ids can be deleted."""
    ids = deleted_ids.filter(F.col("id") > 0).select("id").distinct()
    return bans.join(ids, "id", "left_anti")


def all_bans(*feeds: DataFrame) -> DataFrame:
    """All ban feeds in one frame, duplicates kept."""
    out = feeds[0].select("prefix", "blame", "expires_at")
    for feed in feeds[1:]:
        out = out.unionByName(feed.select("prefix", "blame", "expires_at"))
    return out


def manual_bans(lines: DataFrame, column: str = "line") -> tuple[DataFrame, DataFrame]:
    """JSON ban records -> ``(bans, rejected)``; a supplied id is ignored."""
    record = F.from_json(F.col(column), MANUAL_BAN, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("_r", record).withColumn(
        "_expires", F.col("_r.expires_at").try_cast("timestamp")
    )
    rows = rows.withColumn(
        "_ok",
        F.coalesce(
            parse_prefix("_r.prefix").isNotNull()
            & F.col("_expires").isNotNull()
            & F.col("_r.blame").isNotNull(),
            F.lit(False),
        ),
    )
    rest = [c for c in lines.columns if c != column]
    good = rows.filter("_ok").select(
        *rest, F.col("_r.prefix").alias("prefix"), F.col("_r.blame").alias("blame"),
        F.col("_expires").alias("expires_at"),
    )
    return good, rows.filter(~F.col("_ok")).select(*lines.columns)


def number_bans(client: DataFrame, path: DataFrame, offset: int = 0, limit=None) -> DataFrame:
    """Ids in arrival order, the client bucket's ban before the path bucket's."""
    feeds = client.select("seq", F.lit(0).alias("kind"), "prefix", "blame", "expires_at").unionByName(
        path.select("seq", F.lit(1).alias("kind"), "prefix", "blame", "expires_at")
    )
    feeds = materialize(feeds)  # counted and numbered: detect only once
    numbered = number_rows(feeds, [F.col("seq"), F.col("kind")], "id", limit=limit)
    return numbered.withColumn("id", F.col("id") + F.lit(offset))


class BanTable:
    """Append-only ban records with deletions and versioned compaction.

    Layout below ``path``: ``records/version=V/batch=B`` holds the records,
    ``deleted/version=V`` deleted ids, ``versions`` one row per version with the
    first free id.  A version becomes visible when its row is appended, so a
    failed compaction leaves the table as it was.  One writer at a time.

    ``marks/version=V/batch=B`` holds the first id of a batch and the first one behind
    it, ``head/version=V`` the first free id, so that adding a batch does not read the
    records before it.  They are written in this order: a batch that is written again
    finds its own ids or the head it started from, whatever a crash left out.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def _read(self, part: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _version(self) -> tuple[int, int]:
        top = self._read("versions", "version long, next_id long").agg(
            F.max(F.struct("version", "next_id")).alias("v")
        ).first()["v"]
        return (0, 1) if top is None else (top["version"], top["next_id"])

    def _records(self, version: int) -> DataFrame:
        return self._read(f"records/version={version}", _STORED)

    def _marks(self, part: str) -> tuple[int, int] | None:
        top = self._read(part, _MARK).agg(F.min("first_id").alias("a"), F.max("next_id").alias("b")).first()
        return None if top["b"] is None else (top["a"], top["b"])

    def _first_free(self, version: int, first_free: int) -> int:
        # a head that was being replaced when its writer died is made up from the marks
        head = self._marks(f"head/version={version}") or self._marks(f"marks/version={version}")
        return first_free if head is None else max(first_free, head[1])

    def _mark(self, part: str, first: int, behind: int) -> None:
        frame = self.spark.createDataFrame([(first, behind)], _MARK)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{part}")

    def records(self) -> DataFrame:
        """Everything not deleted, expired or not."""
        version, _ = self._version()
        deleted = self._read(f"deleted/version={version}", "id long")
        return without_deleted(self._records(version).drop("batch"), deleted)

    def list(self, now) -> DataFrame:
        return active_bans(self.records(), now)

    def compile(self, now, dst_ports=(80, 443)) -> DataFrame:
        from leakguard.plans.rules import compile_rules

        return compile_rules(self.records(), now, dst_ports)

    def add(self, bans: DataFrame, batch_id: str | int | None = None) -> None:
        """Append records; writing the same ``batch_id`` again replaces that batch.

        Ids follow ``seq`` (then ``kind``) when the frame has them, so that a
        replayed batch gets the same ids.  An empty batch that was never written leaves
        no trace.
        """
        batch = f"b-{batch_id}" if batch_id is not None else f"u-{uuid.uuid4().hex}"
        version, first_free = self._version()
        seq = "seq" if "seq" in bans.columns else "_seq"
        if seq == "_seq":
            bans = bans.withColumn(seq, F.monotonically_increasing_id())
        order = [seq, *[c for c in ("kind", "prefix", "blame", "expires_at") if c in bans.columns]]
        staged = materialize(bans)  # counted and numbered: run the detection behind it only once
        known = self._marks(f"marks/version={version}/batch={batch}")
        count = staged.count()
        if not count and known is None:
            return
        free = self._first_free(version, first_free)
        first = free if known is None else known[0]
        rows = number_rows(staged, [F.col(c) for c in order], "id", seq=seq)
        rows = rows.withColumn("id", F.col("id") + F.lit(first - 1))
        rows.select(*BAN_RECORD.names).write.mode(
            "overwrite"
        ).parquet(f"{self.path}/records/version={version}/batch={batch}")
        self._mark(f"marks/version={version}/batch={batch}", first, first + count)
        self._mark(f"head/version={version}", first, max(free, first + count))

    def delete(self, ids: DataFrame) -> None:
        version, _ = self._version()
        ids.filter(F.col("id") > 0).select(F.col("id").cast("bigint")).write.mode("append").parquet(
            f"{self.path}/deleted/version={version}"
        )

    def prune(self, now, in_flight: str | int | None = None) -> None:
        """Drop expired and deleted records for good, as a new version.

        ``in_flight`` is a batch that is about to be written, perhaps for the second
        time: what an earlier attempt left of it is not carried over.
        """
        version, first_free = self._version()
        next_id = self._first_free(version, first_free)
        kept = self._records(version)
        if in_flight is not None:
            kept = kept.filter(F.col("batch") != F.lit(f"b-{in_flight}"))
        deleted = self._read(f"deleted/version={version}", "id long")
        kept = unexpired(without_deleted(kept.drop("batch"), deleted), now)
        kept.sort("expires_at").write.mode("overwrite").parquet(
            f"{self.path}/records/version={version + 1}/batch=compacted"
        )
        self.spark.createDataFrame(
            [(version + 1, next_id)], "version long, next_id long"
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def remove_old_versions(self) -> int:
        """Delete the files of versions before the current one; returns how many folders went.

        Readers that still use a frame of an old version fail, so call it when none does.
        """
        current, _ = self._version()
        paths = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        gone = 0
        for part in ("records", "deleted", "marks", "head"):
            folder = paths(f"{self.path}/{part}")
            files = folder.getFileSystem(conf)
            if not files.exists(folder):
                continue
            for entry in files.listStatus(folder):
                name = entry.getPath().getName()
                if name.startswith("version=") and int(name[len("version=") :]) < current:
                    gone += bool(files.delete(entry.getPath(), True))
        return gone
