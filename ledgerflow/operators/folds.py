"""Ordered folds by key, streamed: a task holds one key's state at a time, never its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(rows: DataFrame, by: list[str], order: list[str], begin: Callable, schema: str) -> DataFrame:
    """Rows that ``begin(key).step(row)`` and, after a key's last row, ``.end()`` give.

    Rows are dealt by ``by`` and sorted by ``order`` on the JVM's side, which spills; the fold reads
    them as a stream of batches, so a key of any number of rows needs the memory of its state only.
    ``step`` and ``end`` return lists of tuples of ``schema``; a step gets a named tuple.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, c) for c in by)
                if state is None or own != key:
                    found += state.end() if state is not None else []
                    key, state = own, begin(own)
                found += state.step(row)
            yield pd.DataFrame(found, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)
