"""Ordered per-key computations that do not put one key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to a single task. When one
session, source or document holds a large share of all rows, that task decides the run
time. The scans here split each key into *blocks* along its order (a day, a range of
positions), solve every block in its own task, and carry one summary row per block
across the blocks of the key. The summaries are smaller than the data by the block size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby
from operator import attrgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MERGE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}


class Running:
    """One running aggregate: ``sum``, ``count``, ``max``, ``min`` or ``last`` (last non-null).

    ``before=True`` leaves the current row out. ``lag`` is ``last`` over a struct with ``before``.
    """

    def __init__(self, kind: str, value: Column | str, before: bool = False):
        self.kind = "sum" if kind == "count" else kind
        value = F.col(value) if isinstance(value, str) else value
        self.value = F.when(value.isNotNull(), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")) if kind == "count" else value
        self.before = before

    def over(self, spec):
        fn = {"sum": F.sum, "max": F.max, "min": F.min}.get(self.kind)
        return fn(self.value).over(spec) if fn else F.last(self.value, ignorenulls=True).over(spec)

    def of_block(self, order: Sequence[Column]):
        fn = {"sum": F.sum, "max": F.max, "min": F.min}.get(self.kind)
        if fn:
            return fn(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), F.struct(*order)))

    def carry_over(self, name: str, spec):
        fn = {"sum": F.sum, "max": F.max, "min": F.min}.get(self.kind)
        return fn(name).over(spec) if fn else F.last(name, ignorenulls=True).over(spec)

    def merge(self, carried: Column, local: Column) -> Column:
        if self.kind == "last":
            return F.coalesce(local, carried)
        if self.kind == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return _MERGE[self.kind](carried, local)  # greatest/least skip nulls


def prefix_scan(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str],
                **running: Running) -> DataFrame:
    """Add running aggregates per ``keys`` in ``order``.

    ``block`` names columns that are a prefix of the order (each block is a contiguous run
    of the key's rows when sorted by ``block`` and then ``order``). Without a block the key is
    solved in one task: right only for keys that are bounded by construction, such as the lines
    exploded from the text of one row.
    """
    keys, block, order = list(keys), list(block), list(order)
    if not block:
        whole = Window.partitionBy(*keys).orderBy(*order)
        frame = lambda r: whole.rowsBetween(Window.unboundedPreceding, -1 if r.before else Window.currentRow)
        own = lambda r, c: F.coalesce(c, F.lit(0)) if r.kind == "sum" else c
        return df.select("*", *[own(r, r.over(frame(r))).alias(n) for n, r in running.items()])
    # Blocks are known by one struct, which is never null and equal where its fields are: window and join use one partitioning of the rows.
    at = F.struct(*keys, *block)
    local = Window.partitionBy("__at").orderBy(*order)
    through = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__at", at).select("*", *[r.over(ahead if r.before else through).alias(f"__l_{n}") for n, r in running.items()])
    order_cols = [F.col(c) for c in order]
    blocks = df.groupBy(*keys, *block).agg(*[r.of_block(order_cols).alias(f"__c_{n}") for n, r in running.items()])
    across = Window.partitionBy(*keys).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(at.alias("__at"), *[r.carry_over(f"__c_{n}", across).alias(f"__p_{n}") for n, r in running.items()])
    return out.join(carried, "__at", "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[r.merge(F.col(f"__p_{n}"), F.col(f"__l_{n}")).alias(n) for n, r in running.items()],
    )


def dense_position(df: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str],
                   name: str = "position") -> DataFrame:
    """1-based rank of each row inside its key, without one task per key."""
    return prefix_scan(df, keys, block, order, **{name: Running("count", F.lit(1))})


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per key. Spark limits each map task to ``n`` rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def independent_runs(df: DataFrame, keys: Sequence[str], block: Sequence[str], at: str, reach: str, name: str = "run") -> DataFrame:
    """Cut each key's rows, in the order of ``at``, wherever nothing before reaches on: adds the ``at`` at which the row's run begins.

    ``reach`` is the last place that a row has to do with. Rows of different runs do not depend on each other.
    """
    far = prefix_scan(df, keys, block, [at], __far=Running("max", reach, before=True))
    opens = F.col("__far").isNull() | (F.col("__far") < F.col(at))
    return prefix_scan(far.withColumn("__open", F.when(opens, F.col(at))), keys, block, [at], **{name: Running("max", "__open")}).drop("__far", "__open")


def fold_in_order(df: DataFrame, group: Sequence[str], order: Sequence[str], start: Callable, step: Callable[..., Iterable[tuple]], schema: str,
                  finish: Callable[..., Iterable[tuple]] | None = None) -> DataFrame:
    """Run the rows of each group, in order, through ``step(state, row)``, which yields output rows; ``finish(state)`` may yield more at the end.

    For rules in which every row depends on what the rows before it did. Rows stream through: a task holds one Arrow batch and the
    state of one group, never a group. Make groups small first, by ``independent_runs`` or by solving in columns what needs no order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f.split(" ")[0] for f in schema.split(", ")]
    which = attrgetter(*group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = state = None
        for batch in batches:
            out = []
            for key, rows in groupby(batch.itertuples(index=False), which):
                if state is None or key != current:
                    out += finish(state) if finish and state is not None else []
                    current, state = key, start()
                for row in rows:
                    out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if finish and state is not None:
            yield pd.DataFrame(finish(state), columns=names)

    return df.repartition(n, *group).sortWithinPartitions(*group, *order).mapInPandas(run, schema)
