"""Pages of append-only streams, kept as state per sequence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "n_rows long, n_win long, evicted long, slots array<long>"
OUTPUT = "seq_id long, n_rows long, n_pages long, last_page_len long, n_win long, evicted long, slots array<long>"


def grow(slots: list[int], n_win: int, evicted: int, page: int, budget: int, final: int, ratio: int, n_sink: int) -> tuple[int, int]:
    """Place of a new page among resident ones, in ``slots``; the window's new size and the evictions so far.

    Under the budget a page takes the next slot. At the budget a window that is
    still wide gives up pages and moves left; one of final size has its last
    page overwrite the slot whose turn it is. The new page takes the last slot.
    """
    if len(slots) < budget:
        slots.append(page)
        return n_win, evicted
    if n_win == final:
        at = budget - n_win + evicted % (n_win - 1) if n_win > 1 else n_sink + evicted % (budget - n_sink - 1)
        slots[at] = slots[-1]
        evicted += 1
    else:
        n_win = max(final, n_win - ratio + 1)
        slots[-n_win:-1] = slots[len(slots) - n_win + 1 :]
    slots[-1] = page
    return n_win, evicted


def resident_pages(rows: DataFrame, page_size: int, budget: int, n_win: int = 2, n_sink: int = 2, ratio: int = 2) -> DataFrame:
    """For each sequence with new rows (``seq_id``): its counts and the pages in its slots.

    Only the number of a batch's rows counts here, so their order within a
    batch does not matter; state is a few numbers and ``budget`` slots per
    sequence. Output mode is update: the last row of a sequence is its state.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, win, evicted, slots = state.get if state.exists else (0, n_win, 0, [])
        slots = list(slots)
        pages = -(-n // page_size)
        n += sum(len(f) for f in frames)
        for page in range(pages, -(-n // page_size)):
            win, evicted = grow(slots, win, evicted, page, budget, n_win, ratio, n_sink)
        state.update((n, win, evicted, slots))
        yield pd.DataFrame([(key[0], n, -(-n // page_size), (n - 1) % page_size + 1 if n else 0, win, evicted, slots)], columns=["seq_id", "n_rows", "n_pages", "last_page_len", "n_win", "evicted", "slots"])

    return rows.groupBy("seq_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def run_available(updates: DataFrame, folder: str) -> DataFrame:
    """Takes what the stream has now through to the end, and returns each sequence's last state.

    Updates are written as Parquet under ``folder``, a batch in a folder of its
    own that a repeated batch overwrites, with the query's checkpoint beside them;
    a restart with the same folder goes on where the last run ended.
    """
    spark = updates.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/updates/batch={number}")

    query = updates.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(OUTPUT + ", batch long").parquet(f"{folder}/updates")
    return rows.groupBy("seq_id").agg(F.max_by(F.struct("n_rows", "n_pages", "last_page_len", "n_win", "evicted", "slots"), "batch").alias("s")).select("seq_id", "s.*")
