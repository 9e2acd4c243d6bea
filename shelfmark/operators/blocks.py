"""Every block of one table with every block of another, without a shuffle.

`block_table` writes a table as blocks of bounded size, once. `meet` pairs the blocks: a task holds one
block of each side, reads the blocks of the right side one after the other and folds them into what it
keeps for the left block. No row is sent or written once per block of the other side, so disk and
shuffle grow with the rows of both sides, while the work grows with their product.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shelfmark.operators.common import cut

BLOCK_ROWS = 2048          # rows of a block
BLOCK_BYTES = 64 << 20     # a block of long rows ends early
TASKS_PER_CORE = 4


def block_count(n: int, cores: int, rows: int = BLOCK_ROWS) -> int:
    """Blocks of at most `rows` rows, a few more on small inputs to keep cores busy."""
    by_size = math.ceil(max(n, 1) / rows)
    return max(by_size, min(math.ceil(math.sqrt(2 * cores)), math.ceil(max(n, 1) / 64)))


def block_table(rows: DataFrame, key: str, blocks: int, make: Callable[[pa.Table], Any],
                most: int = 2 * BLOCK_ROWS, placed: bool = False) -> DataFrame:
    """(block, data): about `blocks` blocks of `rows` by hash of `key`, or of rows that are `placed` so
    already, each turned by `make` into what the tasks of `meet` need. Written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size, made = TaskContext.get().partitionId() << 32, [], 0, 0

        def block() -> pa.RecordBatch:
            data = pickle.dumps(make(pa.Table.from_batches(held)), pickle.HIGHEST_PROTOCOL)
            return pa.RecordBatch.from_arrays(
                [pa.array([at + made], pa.int64()), pa.array([data], pa.binary())],
                names=["block", "data"])

        for batch in batches:
            step = max(1, min(most, int(BLOCK_BYTES * batch.num_rows / max(batch.nbytes, 1))))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                rows_held = sum(b.num_rows for b in held)
                if held and (rows_held + part.num_rows > most or size + part.nbytes > BLOCK_BYTES):
                    yield block()
                    held, size, made = [], 0, made + 1
                held.append(part)
                size += part.nbytes
        if sum(b.num_rows for b in held):
            yield block()

    rows = rows if placed else rows.repartition(blocks, key)
    return cut(rows.mapInArrow(run, "block bigint, data binary"))


def meet(left: DataFrame, right: DataFrame, start: Callable[[Any], Any],
         fold: Callable[[Any, Any], None], finish: Callable[[Any], Iterator[tuple]], schema: str,
         whole: bool = False) -> DataFrame:
    """Rows of `schema`: `start` makes a state from a left block, `fold` adds a right block to it, and
    `finish` gives its rows.

    A task goes through a stretch of the pairs, ordered by left block; where there are few left
    blocks, several tasks share one, and each gives rows for the right blocks it has met. With `whole` a
    left block meets all right blocks in one task, which reads them one after the other.
    """
    spark = left.sparkSession
    lefts, cores = left.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism
    pairs = left.rdd.cartesian(right.rdd.coalesce(1) if whole else right.rdd)
    tasks = min(pairs.getNumPartitions(), max(lefts, TASKS_PER_CORE * cores))

    def run(rows: Iterator) -> Iterator[tuple]:
        states: dict[int, Any] = {}
        for a, b in rows:
            if a["block"] not in states:
                if len(states) == 2:
                    yield from finish(states.pop(next(iter(states))))
                states[a["block"]] = start(pickle.loads(a["data"]))
            fold(states[a["block"]], pickle.loads(b["data"]))
        for state in states.values():
            yield from finish(state)

    pairs = pairs if whole else pairs.coalesce(tasks)
    return spark.createDataFrame(pairs.mapPartitions(run), schema, verifySchema=False)


def ids_of(column: pa.ChunkedArray) -> np.ndarray:
    """Ids as they are, nulls as None."""
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out
