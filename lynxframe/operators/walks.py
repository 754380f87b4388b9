"""Rows of a key in order through a small state, for rules in which a decision depends on the ones before.

Keys are hash-partitioned and sorted; a task holds one key's state, not its rows. Where a pause ends every state (a
lifetime, a session), cut the key there first (``timeline.sessions``), so that a long key spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def walk(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """One output row per input row: the keys, then what ``step(state, row)`` returns with the next state.

    ``row`` is a tuple of ``columns``; nulls are None. ``schema`` lists the output columns after the keys.
    """
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *[c.split()[0] for c in schema.split(", ")]]
    ordered = rows.select(*keys, *dict.fromkeys([*order, *columns])).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            batch = batch.astype(object).where(batch.notna(), None)
            for own, row in zip(batch[keys].itertuples(index=False, name=None), batch[columns].itertuples(index=False, name=None), strict=True):
                if own != key:
                    key, state = own, start()
                state, made = step(state, row)
                out.append((*own, *made))
            yield pd.DataFrame(out, columns=names)

    return ordered.mapInPandas(run, f"{types}, {schema}")
