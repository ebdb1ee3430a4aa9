"""Choices that depend on the choices before them, made within one query or conversation of tens of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame


def by_group(rows: DataFrame, key: str, order: list[str], columns: list[str], choose: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``choose`` makes of each group's rows, which come as tuples of ``columns`` (the first is ``key``) in ``order``.

    Groups stay whole in sorted partitions, so that thousands of small ones share one call of Python.
    """
    names = [field.split()[0] for field in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = (r for f in frames for r in zip(*[f[c].tolist() for c in columns], strict=True))
        made: list[tuple] = []
        for _, group in groupby(flat, key=lambda r: r[0]):
            made += choose(list(group))
            if len(made) >= 10_000:
                yield pd.DataFrame(made, columns=names)
                made = []
        yield pd.DataFrame(made, columns=names)

    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
