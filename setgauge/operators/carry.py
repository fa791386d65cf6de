"""Sequential folds over long tracks, cut into chunks.

Some per-set rules are recurrences: each frame needs the result of the one
before. A set is cut into chunks that run in separate tasks. A chunk starts
from the end state of the one before it; as that is not known yet, all chunks
first run from an empty state, and chunks whose incoming state turns out
different run again until nothing changes. The result is exactly that of one
pass over the whole set. Rules that forget their past settle in two or three
rounds, and sets of one chunk need none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 4096


class Fold(Protocol):
    """One recurrence: built per chunk, restored from and saved to bytes."""

    def restore(self, state: bytes | None) -> None: ...

    def step(self, row) -> tuple: ...

    def save(self) -> bytes: ...


def _runner(make: Callable[[], Fold], emit: bool, columns: Sequence[str]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        fold = make()
        start = rows["state"].iloc[0]
        start = None if start is None or len(start) == 0 else bytes(start)
        fold.restore(start)
        made = [fold.step(r) for r in rows.itertuples(index=False)]
        first = rows[["set_id", "chunk"]]
        if not emit:
            return first.head(1).assign(used=start or b"", end=fold.save())
        out = rows[["set_id", "frame_index"]].reset_index(drop=True)
        for at, name in enumerate(columns):
            out[name] = [m[at] for m in made]
        return out

    return run


def carried_fold(
    frames: DataFrame,
    make: Callable[[], Fold],
    outputs: str,
    initial: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Fold ``frames`` (set_id, frame_index, pos, ...) in order per set.

    ``make`` builds the fold, ``outputs`` is the schema text of what ``step``
    returns, ``initial`` optionally gives (set_id, state) to start sets from.
    """
    names = [part.split()[0] for part in outputs.split(",")]
    key_type = frames.schema["set_id"].dataType.simpleString()
    index_type = frames.schema["frame_index"].dataType.simpleString()
    cut = cut_lineage(frames.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long")), "fold_input")
    empty = F.lit(b"")

    def with_starts(starts: DataFrame | None) -> DataFrame:
        if starts is not None:
            joined = cut.join(starts, ["set_id", "chunk"])
        elif initial is not None:
            first = initial.select("set_id", F.lit(0).cast("long").alias("chunk"), "state")
            joined = cut.join(first, ["set_id", "chunk"], "left")
        else:
            joined = cut.withColumn("state", empty)
        return joined.withColumn("state", F.coalesce("state", empty))

    def ends_of(starts: DataFrame | None) -> DataFrame:
        schema = f"set_id {key_type}, chunk long, used binary, end binary"
        return with_starts(starts).groupBy("set_id", "chunk").applyInPandas(_runner(make, False, names), schema)

    starts = None
    if not cut.filter("chunk > 0").isEmpty():
        ends = cut_lineage(ends_of(None), "fold_ends")
        while True:
            before = ends.select("set_id", (F.col("chunk") + 1).alias("chunk"), F.col("end").alias("_before"))
            incoming = F.when(F.col("chunk") == 0, F.col("used")).otherwise(F.coalesce("_before", empty))
            due = cut_lineage(
                ends.join(before, ["set_id", "chunk"], "left").withColumn("state", incoming).drop("_before"), "fold_due"
            )
            stale = due.filter("state <> used")
            starts = due.select("set_id", "chunk", "state")
            if stale.isEmpty():
                break
            again = ends_of(stale.select("set_id", "chunk", "state"))
            kept = due.filter("state = used").select("set_id", "chunk", "used", "end")
            ends = cut_lineage(kept.unionByName(again), "fold_ends")
    schema = f"set_id {key_type}, frame_index {index_type}, {outputs}"
    return with_starts(starts).groupBy("set_id", "chunk").applyInPandas(_runner(make, True, names), schema)
