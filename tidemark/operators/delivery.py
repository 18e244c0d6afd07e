"""Delivery of messages from the tasks, with a record of each attempt.

A transport is called once per message in the task that has it. Tasks may run again, so a message may be sent again: its
``message_id`` is a hash of its dedupe key and the same in every attempt, for receivers and providers to drop repeats by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Called with message_id, recipient, subject, body; raises if the message can't be sent.
Transport = Callable[[str, str, str, str], None]
ERROR_CHARS = 500
ROWS = 256


def delivered(messages: DataFrame, transports: dict[str, Transport | None]) -> DataFrame:
    """The record of each message: dedupe_key, message_id, channel, recipient, status, error.

    messages: dedupe_key, channel, recipient, subject, body. A channel without a transport is skipped, one that isn't known and a
    message without recipient fail, and so does a message whose transport raises; one failure stops no other message.
    """
    columns = ["dedupe_key", "message_id", "channel", "recipient"]
    rows = messages.withColumn("message_id", F.sha2(F.coalesce("dedupe_key", F.lit("")), 256)).select(*columns, "subject", "body")

    def send(message_id: str, channel: str | None, recipient: str | None, subject: str | None, body: str | None) -> tuple[str, str | None]:
        if channel not in transports:
            return "failed", f"unknown channel {channel}"
        if transports[channel] is None:
            return "skipped", None
        if not (recipient or "").strip():
            return "failed", "no recipient"
        try:
            transports[channel](message_id, recipient, subject or "", body or "")
        except Exception as why:  # whatever a transport raises is this message's failure
            return "failed", str(why)[:ERROR_CHARS]
        return "sent", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                out = [send(*row) for row in zip(*(part.column(c).to_pylist() for c in ("message_id", "channel", "recipient", "subject", "body")), strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], pa.array([s for s, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], [*columns, "status", "error"])

    return rows.mapInArrow(run, "dedupe_key string, message_id string, channel string, recipient string, status string, error string")
