"""Sorting rows across the cluster and comparing each with its neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlake.llm.common import stored


def with_equal_neighbour(rows: DataFrame, same: list[str], then: list[str]) -> DataFrame:
    """The rows whose ``same`` columns (numbers) equal those of a neighbour in the order of all columns named.

    The order is cut into ranges by all columns, so rows that agree on ``same`` may lie in several tasks.
    Whoever stands first or last in a task is compared across tasks by a table of two rows a task.
    """
    order, names = [*same, *then], rows.columns

    def work(batches):
        last = None  # the row before, not yet given out, and whether it equals the one before it
        equal_before, begun = False, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            equal = np.ones(max(0, batch.num_rows - 1), bool)
            for name in same:
                values = batch.column(name).to_numpy(zero_copy_only=False)
                equal &= values[1:] == values[:-1]
            matched = np.zeros(batch.num_rows, bool)
            matched[1:] |= equal
            matched[:-1] |= equal
            matched[0] |= equal_before
            border = np.zeros(batch.num_rows, bool)
            border[0] = not begun
            stop = batch.num_rows - 1
            if stop:
                yield given(batch.slice(0, stop), matched[:stop], border[:stop])
                begun = True
            equal_before = bool(matched[-1])
            last = batch.slice(stop)
        if last is not None:
            yield given(last, np.array([equal_before]), np.array([True]))

    def given(batch, matched, border):
        keep = pa.array(matched | border)
        columns = [*batch.columns, pa.array(matched), pa.array(border)]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "_matched", "_border"]).filter(keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ordered.mapInArrow(work, f"{schema}, _matched boolean, _border boolean"), "neighbours")
    across = found.filter("_border").groupBy(*same).agg(F.count("*").alias("_n")).filter("_n > 1")
    across = across.select(*same, F.lit(True).alias("_across"))
    # Two rows a task at most.
    joined = found.join(F.broadcast(across), same, "left")
    return joined.filter(F.col("_matched") | F.coalesce("_across", F.lit(False))).select(*names)
