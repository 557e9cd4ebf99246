"""Arrow batches of rows with long texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 16 << 20
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold at most ``BATCH_BYTES`` (a batch of one longer
    row aside), so that a worker's memory does not depend on how long texts are."""
    conf = df.sparkSession.conf
    if int(conf.get(SETTING).rstrip("b")) > BATCH_BYTES:
        conf.set(SETTING, f"{BATCH_BYTES}b")
    return df


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys`` (long, not null): the last group of a
    batch waits for the next one. Groups must be bounded."""
    open_rows: list[pa.RecordBatch] = []

    def last(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        changes = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        cut = batch.num_rows - 1 - int(np.argmax(changes[::-1])) if changes.any() else 0
        if not cut and open_rows and last(open_rows[-1]) == tuple(c[0] for c in columns):
            open_rows.append(batch)
            continue
        done = [*open_rows, *([batch.slice(0, cut)] if cut else [])]
        if done:
            yield pa.Table.from_batches(done).combine_chunks()
        open_rows = [batch.slice(cut)]
    if open_rows:
        yield pa.Table.from_batches(open_rows).combine_chunks()
