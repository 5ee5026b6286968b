"""Sharding by histogram sort.

Rows get a 63-bit key: the CRC-32 of the text, then bits that spread equal texts. Candidate boundaries (probes) are
laid over the key range; one pass counts exactly the bytes and rows below each, map-side per partition; probes
are then refined between the two nearest to each wanted boundary until every boundary meets the tolerance or holds a
single row. Only then do rows move, in one exchange. The law is `bytes`: shards are of near equal size.

Shards are cut finer than asked (`fine_rows`), and the exchange and the numbering go by fine range, so that no task
holds a whole shard; a row's slot is its position in its range plus the exact number of rows before the range.
Only histograms, of a size set by the number of probes, reach the driver. Copies of a text are neighbours in
key order and share a shard unless they are many; a hot group is spread over as many ranges as its bytes need.

The keys are written once with the rows, before anything is counted, so counting and placing see the same ones whatever
executors come and go; leave long texts out of `rows` and join them later.

Defined cases: a null text has no bytes and CRC 0. Fully repeated rows are told apart by their place in the input, so
they can be split as well. An empty table gives an empty result. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cilake.llm.common import fresh
from cilake.session import written

ROW_BYTES = 16
TOLERANCE = 0.001
FINE_ROWS = 500_000
PROBES = 32
KEY_END = 2**63 - 1


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with size (bytes of the text plus a fixed cost) and text_crc32."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"size": (F.octet_length(value) + F.lit(ROW_BYTES)).cast("bigint"),
                             "text_crc32": F.crc32(F.encode(value, "UTF-8"))})


def sort_key(doc_id: str):
    """text_crc32, then 20 bits of the id's hash, then 11 bits of the row's place."""
    spread = F.xxhash64(doc_id).bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(1 << 11)
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 11) - 1))
    return F.col("text_crc32") * F.lit(1 << 31) + spread + place


def histogram(keyed: DataFrame, key: str, size: str, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe (ascending)."""

    def count(batches):
        total = np.zeros((2, len(probes) + 1), np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(), "right")
            np.add.at(total[0], at, b.column(1).to_numpy())
            total[1] += np.bincount(at, minlength=len(probes) + 1)
        full = np.nonzero(total[1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[0][full]), pa.array(total[1][full])],
                                         names=["at", "bytes", "rows"])

    parts = keyed.select(key, size).mapInArrow(count, "at bigint, bytes bigint, rows bigint")
    got = parts.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()
    out = np.zeros((2, len(probes) + 1), np.int64)
    for r in got:
        out[:, r["at"]] = r["bytes"], r["rows"]
    below = np.cumsum(out, axis=1)[:, :-1]
    return below[0], below[1]


def find_splitters(keyed: DataFrame, key: str, size: str, total: int, rows: int, n_ranges: int, slack: float,
                   probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
    """(first key of each range but the first, rows below it), for ranges of near equal bytes.

    `slack`: bytes that a boundary may be off; finer where it holds more than one row.
    """
    want = np.array([total * k / n_ranges for k in range(1, n_ranges)])
    low, high = np.zeros(len(want), np.int64), np.full(len(want), KEY_END)
    # bytes and rows below `low` and below `high`
    low_at, high_at = np.zeros((2, len(want))), np.tile(np.array([[float(total)], [float(rows)]]), (1, len(want)))
    open_ = np.ones(len(want), bool)
    while open_.any():
        grid = set()
        for k in np.nonzero(open_)[0]:
            a, b = int(low[k]), int(high[k])
            grid.update(a + (b - a) * i // (probes + 1) for i in range(1, probes + 1))
        edge = np.array(sorted(grid), np.int64)
        size_below, rows_below = histogram(keyed, key, size, edge)
        for k in np.nonzero(open_)[0]:
            at = int(np.searchsorted(size_below, want[k], "right"))
            if at > 0 and edge[at - 1] >= low[k]:
                low[k], low_at[:, k] = edge[at - 1], (size_below[at - 1], rows_below[at - 1])
            if at < len(edge) and edge[at] <= high[k]:
                high[k], high_at[:, k] = edge[at], (size_below[at], rows_below[at])
        off = np.minimum(want - low_at[0], high_at[0] - want)
        open_ &= (off > slack) & (high_at[1] - low_at[1] > 1) & (high - low > 1)
    upper = high_at[0] - want < want - low_at[0]
    return np.sort(np.where(upper, high, low)), np.sort(np.where(upper, high_at[1], low_at[1]).astype(np.int64))


def shard(rows: DataFrame, n_shards: int, doc_id: str = "doc_id", tolerance: float = TOLERANCE,
          fine_rows: int = FINE_ROWS) -> DataFrame:
    """`rows` (with size and text_crc32, see `measured`) with law, shard, slot and grown_shard (null under this law)."""
    key, part = fresh(rows, "_key", "_range")
    keyed = written(rows.withColumn(key, sort_key(doc_id)), "keys")
    slim = keyed.select(key, "size")
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    fine = max(1, -(-n // (n_shards * fine_rows)))
    cuts, before = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        cuts, before = find_splitters(slim, key, "size", total, n, n_shards * fine, tolerance * total / n_shards)

    @F.arrow_udf("int")
    def range_of(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, keys.to_numpy(zero_copy_only=False), "right").astype(np.int32))

    @F.arrow_udf("bigint")
    def rows_before(ranges: pa.Array) -> pa.Array:
        starts = np.concatenate([[0], before])
        at = ranges.to_numpy(zero_copy_only=False)
        return pa.array(starts[at] - starts[at // fine * fine])

    ranged = keyed.withColumn(part, range_of(F.col(key)))
    order = Window.partitionBy(part).orderBy(key, doc_id, "size")
    placed = ranged.withColumns({"law": F.lit("bytes"), "slot": F.row_number().over(order).cast("bigint") - 1})
    return placed.withColumns({
        "slot": F.col("slot") + rows_before(F.col(part)),
        "shard": F.floor(F.col(part) / F.lit(fine)).cast("int"),
        "grown_shard": F.lit(None).cast("int"),
    }).drop(key, part)
