"""Streams of scans: the universal scan, which is stateless per text, so that the batch operator runs unchanged; and the latest version of
each scan, kept in the stream's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import universal_scan
from ..sources.store import ScanStore
from ..sources.tables import append_scans


def scan_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    return universal_scan(texts, text_col).drop(text_col)


def append_stream(scans: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch's scan versions; a replayed batch appends equal versions, of which readers take one."""
    return scans.writeStream.foreachBatch(lambda df, _: append_scans(df, path)).option("checkpointLocation", checkpoint).start()


def latest_stream(scans: DataFrame, key: str = "scan_id", version: str = "version") -> DataFrame:
    """The row of each scan with the highest version, as the batch form ``operators.history.latest`` gives it; of equal versions the greatest.

    The state holds one row for each scan and no more, whatever the number of versions; late and repeated versions change nothing.
    Rows with a null key name no scan. The other columns have to be of types that can be compared."""
    rest = [c for c in scans.columns if c != key]
    order = F.struct(version, *[c for c in rest if c != version])
    newest = scans.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_row"))
    return newest.select(*[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in scans.columns])


def update_stream(changes: DataFrame, store: ScanStore, checkpoint: str, order_col: str = "version") -> StreamingQuery:
    """Keep the scans of ``store`` up to date with a stream of changes (scan_id, ``order_col`` and columns to set).

    The stream's state tells the newest change of each scan, so that one that comes late does not undo a newer one; a batch that runs again after
    a failure sets the same values once more."""

    def apply(batch: DataFrame, _: int) -> None:
        store.update(batch.drop(order_col))

    newest = latest_stream(changes, version=order_col)
    return newest.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).start()
