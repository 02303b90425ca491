"""Row-wise operators over streams, and clusters that are brought up to date batch by batch.

The row-wise operators hold no state, so they run on a streaming table as they are. Clusters are global: each
micro-batch is added to the contacts so far, and the whole is resolved again (beyond what batch use needs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from cardloom.config import DedupeConfig, EmailConfig, NameConfig, PhoneConfig
from cardloom.operators.normalize import normalize_contacts
from cardloom.operators.resolve import clusters
from cardloom.schema import conform


def normalize_stream(contacts: DataFrame, name: NameConfig = NameConfig(), phone: PhoneConfig = PhoneConfig(), email: EmailConfig = EmailConfig()) -> DataFrame:
    """A streaming table of normalized contacts. Strict email checks need batches and are refused."""
    if email.strict:
        raise ValueError("strict email checks gather values by contact, which a stream cannot do")
    return normalize_contacts(conform(contacts), name, phone, email)


def resolve_stream(contacts: DataFrame, path: str, publish: Callable[[DataFrame, int], None], cfg: DedupeConfig = DedupeConfig()) -> DataStreamWriter:
    """A writer whose batches are kept under ``path`` and after which ``publish`` gets (idx, cluster_id) of all contacts so far.

    A batch that is repeated after a failure overwrites its own folder, so each contact counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        conform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        publish(clusters(batch.sparkSession.read.parquet(path).drop("batch"), cfg), number)

    return contacts.writeStream.foreachBatch(add)
