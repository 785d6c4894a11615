"""Tables kept in buckets, so that joins on the bucket keys need no exchange.

History and events meet on (user_id, message_id) in every feature that looks back. Buckets by both
columns, not by the recipient alone, spread one recipient with a third of all rows over all buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

REACTION_KEYS = ("user_id", "message_id")
#: Rows of one bucket of the largest table, about; the number of buckets follows from it.
BUCKET_ROWS = 2_000_000


def bucket_count(tables: Iterable[DataFrame], bucket_rows: int = BUCKET_ROWS) -> int:
    """A power of two of at least eight, one for all tables that are to meet."""
    rows, count = max(t.count() for t in tables), 8
    while count * bucket_rows < rows:
        count *= 2
    return count


def store_bucketed(rows: DataFrame, path: str | None, keys: Iterable[str], buckets: int, append_to: str | None = None) -> str:
    """Write rows as a table in buckets below ``path`` and return its name in the catalog.

    The rows are dealt out as the buckets are, so a write makes one file a bucket, in order of the keys. With
    ``append_to`` they are added to the table of that name, which must have the same buckets.
    """
    keys = list(keys)
    dealt = rows.repartition(buckets, *keys)
    name = append_to or f"bucketed_{uuid.uuid4().hex}"
    writer = dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if append_to:
        writer.mode("append").saveAsTable(name)
    else:
        writer.option("path", path).saveAsTable(name)
    return name


def open_bucketed(spark: SparkSession, path: str, ddl: str, keys: Iterable[str], buckets: int) -> str:
    """Name, for this session, of a table that another session stored below ``path``."""
    name, by = f"bucketed_{uuid.uuid4().hex}", ", ".join(f"`{k}`" for k in keys)
    place = path.replace("'", r"\'")
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{place}'")
    return name


@dataclass(frozen=True)
class Reactions:
    """History and events, stored so that they join on recipient and message without an exchange."""

    history: str
    events: str
    buckets: int

    @classmethod
    def store(cls, history: DataFrame, events: DataFrame, folder: str, bucket_rows: int = BUCKET_ROWS) -> "Reactions":
        """Rows with a null key are kept; they join with nothing, as before. Empty tables are stored too."""
        buckets = bucket_count([history, events], bucket_rows)
        return cls(*[store_bucketed(rows, f"{folder}/{part}", REACTION_KEYS, buckets) for rows, part in ((history, "history"), (events, "events"))], buckets)

    def append(self, history: DataFrame, events: DataFrame) -> None:
        """Add a later batch; the buckets stay as they are, with one file more each."""
        for rows, name in ((history, self.history), (events, self.events)):
            store_bucketed(rows, None, REACTION_KEYS, self.buckets, name)

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.table(self.history), spark.table(self.events)
