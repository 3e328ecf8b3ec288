"""The dominant key of a stream of pages, kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "document string, page bigint, dominant string, pages bigint, total bigint"
STATE = "keys array<string>, pages array<bigint>, totals array<bigint>, last array<bigint>"


def track(stream: DataFrame) -> DataFrame:
    """document, page, dominant, pages, total after each page of a stream of document, page, key.

    A document's state has a row for each key seen: on how many pages, how often, and on which page last. Pages of
    a document must come in order, as they do where one job renders them.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("page", kind="stable")
        out = []
        for page, own in rows.groupby("page", sort=True):
            for k, n in own["key"].dropna().value_counts().items():
                pages, total, last = held.get(k, (0, 0, -1))
                held[k] = (pages + (last != page), total + int(n), int(page))
            if held:
                best = min(held, key=lambda k: (-held[k][0], -held[k][1], k))
                out.append((key[0], int(page), best, held[best][0], held[best][1]))
        if held:
            state.update((list(held), *[list(x) for x in zip(*held.values(), strict=True)]))
        yield pd.DataFrame(out, columns=["document", "page", "dominant", "pages", "total"])

    return stream.groupBy("document").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def resumable(stream: DataFrame, build, path: str, checkpoint: str, key: str = "path"):
    """A running query that builds each new file of a stream once and appends it to a table; restarted, it goes on after the last chunk that was committed.

    A chunk's rows replace those of its number, so a chunk that is run again after a failure leaves no copies.
    """

    def commit(chunk: DataFrame, number: int) -> None:
        build(chunk.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/chunk={number}")

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
