"""Order-dependent folds over groups, without a data frame per group.

Rows are brought together by key and sorted inside partitions by Spark; a task then walks its rows once, holds the rows of
one group at a time, and gives off results in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import dealt_again

#: Result rows in a batch.
BATCH = 8192


def fold_groups(rows: DataFrame, by: list[str], order: list[str], fold: Callable[[tuple, list[dict]], list[dict]], schema: StructType | str, reads: list[str] | None = None) -> DataFrame:
    """The rows that fold makes of each group, given its key and its rows in order; a null key is a group too.

    reads: the columns that fold looks at besides the key, if not all; others only give the order.
    """
    made = dealt_again(rows.sparkSession).createDataFrame([], schema).schema
    fields = to_arrow_schema(made)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
        for batch in batches:
            for row in batch.to_pylist():
                yield tuple(row[c] for c in by), row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for key, group in groupby(walk(batches), key=lambda x: x[0]):
            out += fold(key, [row for _, row in group])
            if len(out) >= BATCH:
                yield pa.RecordBatch.from_pylist(out, schema=fields)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=fields)

    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return (dealt if reads is None else dealt.select(*by, *reads)).mapInArrow(run, made)
