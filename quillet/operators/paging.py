"""Page-at-a-time functions without a Python call per group set up by the engine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def by_page(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "page_id") -> DataFrame:
    """function of each page's rows. One shuffle on the page; a task then reads its pages in order and
    holds the page it is in, so thousands of small pages cost one Arrow stream and not a group each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if batch.empty:
                continue
            last = batch[key].iloc[-1]
            same = batch[key].isna() if pd.isna(last) else batch[key] == last  # a null key is a page like others
            whole, held = batch[~same], batch[same]
            out = [function(page) for _, page in whole.groupby(key, sort=False, dropna=False)]
            if out:
                yield pd.concat(out, ignore_index=True)
        if held is not None and len(held):
            yield function(held)

    return rows.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
