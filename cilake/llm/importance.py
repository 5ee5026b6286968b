"""Target-distribution importance resampling: hashed n-gram gains against a target corpus, Gumbel top-k draw.

Words come from an untrained Split of the tokenizers library over ASCII-lowered text, as byte offsets. Windows over the
offset pairs are the features: runs of 1 to `max_run` words, joined by one space, whose CRC-32 (carried on from word to word)
names a bucket. A document is kept as its non-empty buckets with their counts, at most `buckets` of each however long its
text is, so texts are read once and everything after works on narrow rows.

Histograms of all documents and of all target texts are exact sums, pre-aggregated to one dense histogram a
task. The table of gains has one row a bucket: its size is the parameter `buckets`, so it may go to the driver and
back to the tasks. A document's weight is the sum of its counts times gains; Gumbel noise from the SHA-256 of its id
makes the highest scores a draw without replacement with chances by weight.

Ranks are global: rows are range-partitioned by score, sorted inside their partition and numbered by the partition's place,
so no task holds more than a range. The range sort and the features are written tables, so a lost executor changes nothing.

Defined cases: a null or empty text has no words, weight 0 and is never drawn while `min_words` is positive. A null doc_id draws as
the text `null` and loses ties. Rows that agree in score and id are ordered by their place in the written table; as their
results differ in rank only, the returned rows are the same after a rerun. Long texts are split in blocks of about 2 KB, cut
where no word is; the last words of a block go on into the next. An empty table gives an empty result; without target texts all
gains follow from T = t = 0. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import PreTokenizedString, Regex, pre_tokenizers

from cilake.llm.common import fresh, small_batches, struct_udf
from cilake.session import written

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
BLOCK_BYTES = 2048
#: All ASCII but digits and lower-case letters; what is not ASCII belongs to words.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_BREAK_BYTE = re.compile(_BREAK.encode())


def blocks(data: bytes) -> Iterator[bytes]:
    """`data` in pieces of at least `BLOCK_BYTES` that end where no word is cut."""
    start = 0
    while start < len(data):
        cut = _BREAK_BYTE.search(data, start + BLOCK_BYTES)
        end = cut.start() if cut else len(data)
        yield data[start:end]
        start = end


def word_spans(block: bytes, split: pre_tokenizers.Split) -> list[tuple[int, int]]:
    """Byte offsets of the words of a block."""
    held = PreTokenizedString(block.decode())
    split.pre_tokenize(held)
    return [span for _, span, _ in held.get_splits("original", "byte")]


def feature_counts(data: bytes, max_run: int, buckets: int, split: pre_tokenizers.Split) -> tuple[int, Counter]:
    """Number of words, and how often each bucket is met by the runs of 1 to `max_run` words of lower-cased `data`."""
    words, met, open_ = 0, Counter(), []
    crc = zlib.crc32
    for block in blocks(data):
        spans = word_spans(block, split)
        words += len(spans)
        if max_run == 1:
            met.update([crc(block[a:b]) % buckets for a, b in spans])
            continue
        for a, b in spans:  # open_[i]: CRC of the run of i + 1 words that ends before this word
            word = block[a:b]
            open_ = [crc(word), *[crc(b" " + word, so_far) for so_far in open_[: max_run - 1]]]
            met.update([c % buckets for c in open_])
    return words, met


def featured(docs: DataFrame, text: str = "text", max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """`docs` without the text, with n_words, n_features, and the packed 32-bit arrays `at` (buckets) and `met` (counts)."""
    fields = [("n_words", "bigint", pa.int64()), ("n_features", "bigint", pa.int64()),
              ("at", "binary", pa.binary()), ("met", "binary", pa.binary())]
    kept: list[pre_tokenizers.Split] = []  # one a task

    def row(data: bytes | None) -> tuple:
        if not kept:
            kept.append(pre_tokenizers.Split(Regex(_BREAK + "+"), behavior="removed"))
        words, met = feature_counts((data or b"").lower(), max_run, buckets, kept[0])
        at = np.fromiter(met.keys(), np.uint32, len(met))
        count = np.fromiter(met.values(), np.uint32, len(met))
        return words, met.total(), at.tobytes(), count.tobytes()

    (found,) = fresh(docs, "_found")
    new = [n for n, _, _ in fields]
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in new]
    made = small_batches(docs).withColumn(found, struct_udf(fields, row)(F.col(text)))
    return made.select(*rest, *[F.col(found)[n].alias(n) for n in new])


def packed(column: pa.Array) -> np.ndarray:
    """All 32-bit numbers of a column of packed arrays."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32)


def histogram(rows: DataFrame, buckets: int, name: str) -> DataFrame:
    """(bucket, `name`): the features of all rows by bucket, where there are any."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, packed(b.column(0)), packed(b.column(1)))
        full = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], names=["bucket", name])

    return rows.select("at", "met").mapInArrow(count, f"bucket int, {name} bigint").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(rows: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain bigint) of every bucket: thousandths of the log ratio of smoothed target and source shares."""
    all_s, all_t = histogram(rows, buckets, "s"), histogram(target, buckets, "t")
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    met = every.join(all_s, "bucket", "left").join(all_t, "bucket", "left").fillna(0, ["s", "t"])
    met = written(met, "histograms")
    all_s, all_t = met.agg(F.sum("s"), F.sum("t")).first()
    smooth = lambda name: (F.col(name) + 1).cast("double")
    ratio = smooth("t") * F.lit(float(all_s + buckets)) / (smooth("s") * F.lit(float(all_t + buckets)))
    return met.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weighed(rows: DataFrame, gain: DataFrame) -> DataFrame:
    """`rows` of `featured` with weight, without the packed arrays; `gain` has one row a bucket."""
    table = np.array([r["gain"] for r in gain.orderBy("bucket").collect()], np.int64)

    @F.arrow_udf("bigint")
    def weight(at: pa.Array, met: pa.Array) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(table[packed(at)] * packed(met))])
        ends = np.cumsum([len(x.as_buffer()) // 4 if x.is_valid else 0 for x in at]).astype(np.int64)
        return pa.array(np.diff(sums[np.concatenate([[0], ends])]).astype(np.int64))

    return rows.withColumn("weight", weight("at", "met")).drop("at", "met")


def gumbel(doc_id: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def drawn(scored: DataFrame, doc_id: str = "doc_id", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows of `scored` (n_words, score) with rank: 1, 2, … for the drawn ones, else null."""
    row, place = fresh(scored, "_row", "_place")
    numbered = written(scored.withColumn(row, F.monotonically_increasing_id()), "scores")
    eligible = F.coalesce(F.col("n_words"), F.lit(0)) >= min_words
    n = numbered.filter(eligible).count()
    order = [F.when(eligible, 0).otherwise(1), F.col("score").desc(), F.col(doc_id).asc_nulls_last(), F.col(row)]
    # after the sort this id is the number of the range, then the position in it
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    part = F.shiftright(place, 33)
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    met = ranged.join(F.broadcast(starts), part == F.col("_part"))
    rank = F.col("_before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rest = [F.col(f"`{c}`") for c in scored.columns if c.lower() != "rank"]
    return met.select(*rest, F.when(eligible & (rank <= n * percent // 100), rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             max_run: int = MAX_RUN, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT,
             min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` without the text, with n_words, n_features, weight, score and rank (null: not drawn)."""
    rows = written(featured(docs, text, max_run, buckets), "features")
    wanted = written(featured(target.select(F.col(target_text).alias("text")), "text", max_run, buckets), "target-features")
    weights = weighed(rows, gains(rows, wanted, buckets))
    return drawn(weights.withColumn("score", F.col("weight") + gumbel(doc_id, seed)), doc_id, percent, min_words)
