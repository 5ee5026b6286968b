"""Quality rules: compression bands.

A document's zstandard ratio (compressed size / size) over the whole text and over fixed chunks
tells repetitive text (ratio below the band) and incompressible text (ratio above it). The longer a text, the
better it compresses, so each length class has limits of its own. A document is rejected by
  * the base rules: fewer than `MIN_WORDS` words, or more than half of its words in repeated 3-word windows;
  * its whole ratio outside the band of its length class;
  * at least `CHUNK_SHARE` of its chunks outside the chunk band.

Everything is computed per row in one narrow pass: no shuffle, and memory for one Arrow batch.

Defined cases: a null or empty text has no words, null ratios, and fails the base rules. Repeated rows
are judged alike. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh, small_batches, struct_udf

MIN_WORDS = 50
REPEAT_PERCENT = 50
LEVEL = 3
CHUNK_BYTES = 4096
CHUNK_BAND = (0.425, 0.62)
CHUNK_SHARE = 0.25
SYMBOLS = b"#*$%&|<>"

#: (at least so many bytes, lowest ratio kept, highest ratio kept). Above 64 KB the lowest ratio follows joined clean
#: documents down, with a margin; the chunks tell repetition there.
BANDS = (
    (0, 0.50, 1.20),
    (256, 0.52, 0.85),
    (512, 0.48, 0.78),
    (1024, 0.445, 0.70),
    (2048, 0.44, 0.64),
    (4096, 0.418, 0.60),
    (8192, 0.40, 0.58),
    (16384, 0.385, 0.56),
    (65536, 0.36, 0.54),
    (131072, 0.345, 0.54),
    (262144, 0.33, 0.54),
    (524288, 0.31, 0.54),
    (1048576, 0.29, 0.54),
)

FIELDS = [
    ("n_words", "bigint", pa.int64()),
    ("word_chars", "bigint", pa.int64()),
    ("n_symbols", "bigint", pa.int64()),
    ("n_dup_lines", "bigint", pa.int64()),
    ("n_repeat_words", "bigint", pa.int64()),
    ("base_failed", "boolean", pa.bool_()),
    ("ratio", "double", pa.float64()),
    ("bad_chunks", "double", pa.float64()),
    ("kept", "boolean", pa.bool_()),
]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pairs[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def chunk_ratios(data: bytes, compress, size: int) -> list[float]:
    """Ratios of the fixed chunks; a last chunk under half the size is left to the whole ratio."""
    parts = (data[k : k + size] for k in range(0, len(data), size))
    return [len(compress(p)) / len(p) for p in parts if 2 * len(p) >= size]


def judge(data: bytes | None, compress, bands=BANDS, chunk_band=CHUNK_BAND, chunk_share=CHUNK_SHARE,
          chunk_bytes=CHUNK_BYTES) -> tuple:
    """The values of `FIELDS` for one text."""
    data = data or b""
    words = data.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    ratio = len(compress(data)) / len(data) if data else None
    chunks = chunk_ratios(data, compress, chunk_bytes)
    bad = sum(not chunk_band[0] <= x <= chunk_band[1] for x in chunks) / len(chunks) if chunks else 0.0
    _, low, high = max(b for b in bands if b[0] <= len(data))
    kept = not failed and low <= ratio <= high and not (chunks and bad >= chunk_share)
    return (len(words), len(b"".join(words).decode()), len(data) - len(data.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeats, failed, ratio, bad if data else None, kept)


def judgement(bands=BANDS, chunk_band=CHUNK_BAND, chunk_share: float = CHUNK_SHARE,
              chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL):
    """The column function text -> struct of `FIELDS`."""
    squeeze: list = []

    def row(data: bytes | None) -> tuple:
        if not squeeze:  # made on the executor, once per worker
            squeeze.append(zstandard.ZstdCompressor(level=level))
        return judge(data, squeeze[0].compress, bands, chunk_band, chunk_share, chunk_bytes)

    return struct_udf(FIELDS, row)


def assess(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """`docs` with the columns of `FIELDS`; `limits` as in `judgement`."""
    (found,) = fresh(docs, "_judged")
    names = [n for n, _, _ in FIELDS]
    judged = small_batches(docs).withColumn(found, judgement(**limits)(F.col(text)))
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return judged.select(*rest, *[F.col(found)[n].alias(n) for n in names])


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of `docs` that pass, with their own columns only."""
    (found,) = fresh(docs, "_judged")
    judged = small_batches(docs).withColumn(found, judgement(**limits)(F.col(text)))
    return judged.filter(F.col(found)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
