"""Stored scans with their fields and audit events: bucketed tables, updates by key as new versions, compaction.

The three tables are bucketed and sorted by scan_id, so that what reads a scan's current row or joins its fields needs no shuffle of a table.
Nothing is changed in place. An update appends the next version of the rows that it names; readers take the highest version of each
scan, and of equal versions, as a job that ran twice leaves them, the one that was inserted last by its ``written`` stamp. Compaction
writes the current rows anew and puts that table in the place of the old one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import STORED

KEY = "scan_id"


def _columns(table: str) -> list[str]:
    return [c.split()[0] for c in STORED[table].split(", ")]


class ScanStore:
    """Tables ``<name>_scans``, ``<name>_fields`` and ``<name>_audit_events`` of the session's catalogue."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 32):
        self.spark, self.name, self.buckets = spark, name, buckets

    def table_name(self, table: str) -> str:
        return f"{self.name}_{table}"

    def table(self, table: str) -> DataFrame:
        return self.spark.read.table(self.table_name(table))

    def _create(self, table: str, name: str) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({STORED[table]}, written timestamp) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {self.buckets} BUCKETS")

    def create(self) -> ScanStore:
        for table in STORED:
            self._create(table, self.table_name(table))
        return self

    def drop(self) -> None:
        for table in STORED:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.table_name(table)}")

    def _append(self, table: str, rows: DataFrame, name: str | None = None) -> None:
        kinds = {f.name: f.dataType for f in self.table(table).schema}
        given = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in _columns(table)]
        # one task for each bucket, so that a bucket is one file and not one for each task
        dealt = rows.select(*given, F.current_timestamp().alias("written")).repartition(self.buckets, KEY)
        dealt.write.insertInto(name or self.table_name(table))

    def insert(self, table: str, rows: DataFrame) -> None:
        """Append rows; columns that are missing are null, a scan without a version has the first. Further columns are left out."""
        if table == "scans":
            rows = rows.withColumn("version", F.coalesce(F.col("version"), F.lit(1)) if "version" in rows.columns else F.lit(1))
        self._append(table, rows)

    def current(self) -> DataFrame:
        """The current row of each scan, without a shuffle; rows with a null key name no scan."""
        rest = [c for c in _columns("scans") if c != KEY]
        last = F.max_by(F.struct(*rest), F.struct("version", "written", *[F.col(c).alias(f"_{c}") for c in rest]))
        return self.table("scans").where(F.col(KEY).isNotNull()).groupBy(KEY).agg(last.alias("_row")).select(KEY, "_row.*")

    def update(self, changes: DataFrame) -> None:
        """Set the columns of ``changes`` (besides scan_id) for the scans that it names, to null as well; scans that are not stored stay unknown.

        Of several changes of one scan the greatest counts."""
        columns = [c for c in changes.columns if c != KEY and c in _columns("scans") and c != "version"]
        one = changes.groupBy(KEY).agg(F.max(F.struct(*columns)).alias("_new"))
        joined = self.current().join(one, KEY)
        self._append("scans", joined.withColumns({c: F.col(f"_new.{c}") for c in columns} | {"version": F.col("version") + 1}))

    def compact(self) -> None:
        """Keep the current row of each scan only. The old table stays until the new one is whole."""
        name = self.table_name("scans")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}_new")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}_old")
        self._create("scans", f"{name}_new")
        self._append("scans", self.current(), f"{name}_new")
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old")
        self.spark.sql(f"ALTER TABLE {name}_new RENAME TO {name}")
        self.spark.sql(f"DROP TABLE {name}_old")

    def joined(self, table: str = "fields") -> DataFrame:
        """Fields or audit events with the current row of their scan."""
        own = self.table(table).drop("written")
        return own.join(self.current().withColumnsRenamed({c: f"scan_{c}" for c in own.columns if c != KEY}), KEY)

    def orphans(self, table: str = "fields") -> DataFrame:
        """Fields or audit events whose scan is not stored; a null key has none."""
        return self.table(table).drop("written").join(self.table("scans").select(KEY), KEY, "left_anti")
