"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLAB_BYTES = 4_000_000
TEXT_ROWS = 500


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of `df`, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with Arrow batches of `TEXT_ROWS` rows in its session unless the user has chosen another size.

    Whole documents are large rows: at Spark's default of 10,000 rows a batch, and the rows that wait for it, take some
    hundred MB of each task.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(TEXT_ROWS))
    return df


def struct_udf(fields: list[tuple[str, str, pa.DataType]], row: Callable[[bytes | None], tuple]) -> Callable[..., Column]:
    """An Arrow function text -> struct that calls `row` with the UTF-8 bytes of each value (None for null).

    Texts are taken out of the Arrow batch one at a time, so memory holds one batch and its results.
    """
    ddl = "struct<" + ",".join(f"{n}:{t}" for n, t, _ in fields) + ">"
    kind = pa.struct([pa.field(n, a) for n, _, a in fields])

    @F.arrow_udf(ddl)
    def over(texts: pa.Array) -> pa.Array:
        rows = [row(None if t is None else t.encode()) for t in (x.as_py() for x in texts)]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
        arrays = [pa.array(c, type=a) for c, (_, _, a) in zip(columns, fields, strict=True)]
        return pa.StructArray.from_arrays(arrays, fields=list(kind))

    return over


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows`, of which there are `total`, left-joined with `groups`: one row a `key`, `size` of them rows each.

    Keys of a thousandth of all rows or more are at most 1,000, so these groups are broadcast whatever the data is, and the
    rows of a hot key stay where they are. The others meet in a plain join. Both inputs should be tables; keys are not null.
    """
    hot = F.col(size) * 1000 >= total
    few = F.broadcast(groups.filter(hot))
    cold = rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key, "left")
    return rows.join(few, key).unionByName(cold)


def slabs(sizes: Iterable[int], limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [a, b) of items whose sizes sum to about `limit`; one larger item is a range of its own."""
    start, total, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if k >= start:
        yield start, k + 1
