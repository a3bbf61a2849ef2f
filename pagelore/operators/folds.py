"""Ordered folds over small groups, many groups to an Arrow batch.

`applyInPandas` costs a millisecond or more for each group, which is the whole
time when groups are pages. Here the JVM sorts each group into one array and
Python folds a batch of such rows at a time. Groups must be bounded by their
nature (a page, a parse); no skewed key belongs here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 128


def fold_groups(df: DataFrame, by: Sequence[str], order: Sequence[str], fold: Callable[[list[dict]], list[tuple]], out: StructType) -> DataFrame:
    """Rows that `fold` gives for each group's rows in `order`; each result starts with the group's key values.

    `out` is the schema of key and results. `order` columns come first in the
    rows, nulls first; every column of `df` but the key is available.
    """
    rest = [*order, *[c for c in df.columns if c not in by and c not in order]]
    grouped = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("__rows"))
    keys, schema = list(by), to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                named = [part.column(k).to_pylist() for k in keys]
                found = [(*key, *r) for key, rows in zip(zip(*named, strict=True), part.column("__rows").to_pylist(), strict=True) for r in fold(rows)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    return grouped.mapInArrow(run, out)
