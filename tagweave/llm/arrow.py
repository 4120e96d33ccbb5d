"""Arrow batches of bounded size for the operators that run Python in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows are handed to a worker and on in batches of about this many bytes; a worker and the JVM hold a few copies of one.
BATCH_BYTES = 1 << 20
_INPUT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` with input batches of about ``BATCH_BYTES``.

    Spark's own bound is 64 MiB (and 10,000 rows, 35 MB of documents), of which each running task has a
    few copies in the JVM, outside its heap, and in its worker.  The bound is the session's: it
    is set unless the user has set one.
    """
    conf = df.sparkSession.conf
    if conf.get(_INPUT_BYTES, None) is None:
        conf.set(_INPUT_BYTES, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> Iterator[str]:
    """One text after the other (null: empty), without a list of all of them."""
    for value in column:
        yield value.as_py() or ""


class Batches:
    """Collects rows and cuts them into record batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, *row, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 16
        if self.size >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            cols = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(cols, schema=self.schema)
