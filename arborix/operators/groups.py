"""Walking through the groups of a DataFrame inside tasks, without a frame for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def walked(rows: DataFrame, key: str, order: list[str], step: Callable[[object, Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``step`` on each group of equal ``key``: it gets the key and an iterator over the group's rows in ``order``, and gives rows of ``schema``.

    Rows are dealt out by key and sorted, then stream through each task, so a step that keeps little needs little memory
    however large its group is. Null keys are a group.
    """
    columns, types = rows.columns, to_arrow_schema(StructType.fromDDL(schema))

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made), types)], schema=types)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(key)
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        ahead = next(stream, None)
        out: list[tuple] = []
        while ahead is not None:
            own = ahead[at]

            def group() -> Iterator[tuple]:
                nonlocal ahead
                while ahead is not None and ahead[at] == own:
                    row, ahead = ahead, next(stream, None)
                    yield row

            rest = group()
            for made in step(own, rest):
                out.append(made)
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
            for _ in rest:  # what the step did not read
                pass
        if out:
            yield batch(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(walk, schema)
