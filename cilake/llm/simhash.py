"""SimHash near-dedup by tiled exact comparison.

Fingerprints: every word shingle is hashed (XXH64, seed 42); a bit of the fingerprint is set where it is set in
over half of the hashes. Wider fingerprints take further 64-bit words, mixed from the same hashes.

Linking compares distinct fingerprints exactly, in tiles:
  1. Fingerprints form classes: by the population counts of the parts of their first word, and, if wanted, by
     the logarithm of their number of shingles. Each class is cut into tiles of about `tile_rows` by hash.
  2. A tile meets only tiles of classes that can hold a partner: differing bits are at least the sum of the
     differences of the parts' population counts, and sets of similarity s differ in size by at most 1 / s.
     So pairs of classes beyond the radius are never formed; nothing within the radius is lost.
  3. A pair of tiles is compared by numpy exclusive-or and bit counts. Each tile is first compared with itself, and
     what it links inside is contracted to heads: one link a fingerprint. Two different tiles then pass on links between
     heads only, so a group that fills T tiles gives at most T links for each of them, not one for each of its rows.
Components come from hooking and shortcutting over these rows (`components`), in tables only: no link,
component or fingerprint reaches the driver. Equal fingerprints are one node, however many documents hold it.

Cost: the number of compared pairs grows with the square of the distinct fingerprints, times the share of
class pairs that stay within the radius (about 4 % for 64 bits in 4 parts and radius 3).

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like any other;
with fewer words than a shingle, the whole sequence is the shingle. Rows with a null doc_id get fingerprints
and link, but a component's id is its smallest non-null doc_id. Repeated rows share a component. Empty tables
give empty results. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh, join_groups, small_batches, struct_udf
from cilake.session import written

SEED = 42
TILE_ROWS = 1024
PARTS = 4
_COLUMN_ROWS = 255  # rows whose bits still sum up in one byte
_SLAB = 255 * 64


def shingle_hashes(data: bytes, width: int, distinct: bool) -> np.ndarray:
    """Unsigned XXH64 of the space-joined `width`-word shingles of A-Z-lower-cased text."""
    words = data.lower().split()  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D only
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)),
                         np.uint64, len(starts))
    return np.unique(hashes) if distinct else hashes


def mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """The hashes for fingerprint word `word`: themselves for 0, else scrambled by a multiply-xorshift step."""
    if word == 0:
        return hashes
    x = hashes ^ np.uint64((word * 0xD6E8FEB86659FD93) % 2**64)
    for shift in (32, 29):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """`words` big-endian 64-bit words; a bit is set if it is set in over half of the hashes."""
    counts = np.zeros(64 * words, np.int64)
    for k in range(0, len(hashes), _SLAB):
        part = hashes[k : k + _SLAB]
        rows = np.stack([mixed(part, w) for w in range(words)], axis=1).astype(">u8").view(np.uint8)
        bits = np.unpackbits(rows.reshape(len(part), 8 * words), axis=1)
        for r in range(0, len(part), _COLUMN_ROWS):
            counts += np.add.reduce(bits[r : r + _COLUMN_ROWS], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(">u8")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """`docs` with `fp` (8 * words bytes) and `n_shingles`."""
    fields = [("fp", "binary", pa.binary()), ("n_shingles", "bigint", pa.int64())]

    def row(data: bytes | None) -> tuple:
        hashes = shingle_hashes(data or b"", width, distinct)
        return fingerprint(hashes, words).tobytes(), len(hashes)

    (found,) = fresh(docs, "_found")
    new = [n for n, _, _ in fields]
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return small_batches(docs).withColumn(found, struct_udf(fields, row)(F.col(text))).select(*rest, *[F.col(found)[n].alias(n) for n in new])


def part_counts(parts: int) -> list[Column]:
    """Population counts of `parts` parts of about equal width of a fingerprint's first word."""
    first = F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("bigint")
    cuts = [64 * k // parts for k in range(parts + 1)]
    masks = [F.lit((1 << (b - a)) - 1 if b - a < 64 else -1) for a, b in itertools.pairwise(cuts)]
    return [F.bit_count(F.shiftrightunsigned(first, a).bitwiseAND(m)).cast("int") for a, m in zip(cuts, masks)]


def near_classes(parts: int, radius: int, sized: bool) -> list[tuple[int, ...]]:
    """Offsets from a class to those that may hold partners, one of each opposite pair; the own class first."""
    spans = [range(-radius, radius + 1)] * parts + [range(-1, 2)] * sized
    near = [o for o in itertools.product(*spans) if sum(map(abs, o[:parts])) <= radius]
    return sorted(o for o in near if o >= (0,) * len(o))


def node_of(similarity: float | None) -> Column:
    """What is compared: the fingerprint, and the number of shingles as one more word where sizes count."""
    size = F.unhex(F.lpad(F.hex("n_shingles"), 16, "0"))
    return F.concat("fp", size) if similarity else F.col("fp")


def tiles(nodes: DataFrame, parts: int, similarity: float | None, tile_rows: int) -> DataFrame:
    """class array<int>, tile, packed binary (the tile's nodes, one after another) of distinct (fp, n_shingles, node)."""
    kind = part_counts(parts) if parts else []
    if similarity:
        step = F.lit(-math.log(similarity) * (1 + 1e-9))  # equal ratios may not straddle two bounds
        kind = [*kind, F.floor(F.log(F.greatest("n_shingles", F.lit(1)).cast("double")) / step).cast("int")]
    classed = nodes.select(F.array(*kind).cast("array<int>").alias("class"), "node")
    counts = classed.groupBy("class").agg(F.ceil(F.count("*") / F.lit(tile_rows)).alias("n_tiles"))
    tiled = classed.join(counts, "class").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("n_tiles")))
    return tiled.groupBy("class", "tile").agg(F.listagg("node").alias("packed"))


def differing(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of `a` and `b` (n x words) that differ in at most `radius` bits.

    Words are compared one after another; once few pairs are left within the radius, only these go on.
    """
    words = a.shape[1]
    far = np.bitwise_count(a[:, 0][:, None] ^ b[:, 0][None, :])
    if words > 1:
        far = far.astype(np.uint16)
    for w in range(1, words):
        far += np.bitwise_count(a[:, w][:, None] ^ b[:, w][None, :])
        if w % 4 == 3 and 16 * np.count_nonzero(near := far <= radius) < far.size:
            i, j = np.nonzero(near)
            rest = np.bitwise_count(a[i, w + 1 :] ^ b[j, w + 1 :]).sum(axis=1, dtype=np.int64)
            close = far[i, j] + rest <= radius
            return i[close], j[close]
    return np.nonzero(far <= radius)


def forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """A few of the links, enough to connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(left, right, strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def unpacked(packed: bytes, width: int) -> np.ndarray:
    return np.frombuffer(packed, ">u8").astype(np.uint64).reshape(-1, width)


def linked(a: np.ndarray, b: np.ndarray, same: bool, words: int, radius: int, similarity: float | None,
           strip: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that one pair of tiles links, compared in strips of rows of like population count."""
    strips = [(np.arange(len(a)), np.arange(len(b)))]
    if len(a) > strip or len(b) > strip:
        count_a, count_b = (np.bitwise_count(x[:, :words]).sum(axis=1, dtype=np.int64) for x in (a, b))
        rows, columns = np.argsort(count_a), np.argsort(count_b)
        low = np.searchsorted(count_b[columns], count_a[rows[::strip]] - radius)
        high = np.searchsorted(count_b[columns], count_a[rows[np.minimum(np.arange(strip - 1, len(a) + strip - 1, strip), len(a) - 1)]] + radius, "right")
        strips = [(rows[k * strip : (k + 1) * strip], columns[x:y]) for k, (x, y) in enumerate(zip(low, high, strict=True)) if x < y]
    for rows, columns in strips:
        i, j = differing(a[rows, :words], b[columns, :words], radius)
        i, j = rows[i], columns[j]
        if similarity and len(i):
            n, m = a[i, words].astype(float), b[j, words].astype(float)
            good = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
            i, j = i[good], j[good]
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            yield i, j


def tile_heads(packed: bytes, words: int, radius: int, similarity: float | None) -> np.ndarray:
    """For each node of a tile the first node that links inside the tile connect it with."""
    nodes = unpacked(packed, words + bool(similarity))
    head = np.arange(len(nodes))
    for i, j in linked(nodes, nodes, True, words, radius, similarity):
        pairs = np.unique(np.stack([head[i], head[j]]), axis=1)
        for x, y in forest(*pairs.tolist()):
            p, q = head[x], head[y]
            head[head == max(p, q)] = min(p, q)
    return head


def tile_links(packed_a: bytes, heads_a: np.ndarray, packed_b: bytes, heads_b: np.ndarray, words: int, radius: int,
               similarity: float | None) -> list[tuple[bytes, bytes]]:
    """Pairs of head nodes that connect what a pair of different tiles links: at most one for two heads."""
    width = words + bool(similarity)
    a, b, kept = unpacked(packed_a, width), unpacked(packed_b, width), []
    for i, j in linked(a, b, False, words, radius, similarity):
        pairs = np.unique(np.stack([heads_a[i], heads_b[j]]), axis=1)
        kept += forest(pairs[0].tolist(), (pairs[1] + len(a)).tolist())
    size = 8 * width
    return [(packed_a[size * x : size * (x + 1)], packed_b[size * (y - len(a)) : size * (y - len(a) + 1)])
            for x, y in (forest(*zip(*kept, strict=True)) if kept else [])]


def links(nodes: DataFrame, words: int, radius: int, parts: int = PARTS, similarity: float | None = None,
          tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): pairs of nodes, from distinct (fp, n_shingles, node), that connect all links within the radius."""
    size = 8 * (words + bool(similarity))

    def contract(batches):
        for batch in batches:
            heads = [tile_heads(x.as_py(), words, radius, similarity).astype("<i4").tobytes() for x in batch["packed"]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["class", "tile", "packed", "heads"])

    def inside(batches):
        for batch in batches:
            found = [(x[size * k : size * (k + 1)], x[size * h : size * (h + 1)])
                     for x, heads in zip(batch["packed"].to_pylist(), batch["heads"].to_pylist(), strict=True)
                     for k, h in enumerate(np.frombuffer(heads, "<i4").tolist()) if h != k]
            yield edge_batch(found)

    cut = tiles(nodes, parts, similarity, tile_rows).select("class", "tile", "packed")
    cut = written(cut.mapInArrow(contract, "class array<int>, tile bigint, packed binary, heads binary"), "tiles")
    offsets = near_classes(parts, radius, bool(similarity))
    near = F.array(*[F.array(*[F.lit(x) for x in o]) for o in offsets])
    own = F.col("_o") == F.array(*[F.lit(0) for _ in offsets[0]])
    mine = cut.select(F.explode(near).alias("_o"), "class", F.col("tile").alias("tile_a"), F.col("packed").alias("packed_a"), F.col("heads").alias("heads_a"))
    mine = mine.select(F.zip_with("class", "_o", lambda x, y: x + y).alias("class"), own.alias("own"), "tile_a", "packed_a", "heads_a")
    met = mine.join(cut, "class").filter(~F.col("own") | (F.col("tile_a") < F.col("tile")))

    def across(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield edge_batch([x for a, heads_a, b, heads_b in rows for x in tile_links(
                a, np.frombuffer(heads_a, "<i4"), b, np.frombuffer(heads_b, "<i4"), words, radius, similarity)])

    between = met.select("packed_a", "heads_a", "packed", "heads").mapInArrow(across, "a binary, b binary")
    return between.unionByName(cut.select("packed", "heads").mapInArrow(inside, "a binary, b binary"))


def edge_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node of an edge.

    Alternates two steps until nothing changes: every node's neighbours hook on to the smallest node around
    it, first the larger neighbours, then the smaller ones. Each step is one aggregate with map-side combine
    and one join; the number of rounds grows with the logarithm of a component's size.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edge = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edge = written(edge, "edges")
    before = state(edge)
    while True:
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = written(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state(edge)
        if now == before:
            roots = edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        before = now


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, words: int = 1,
                radius: int = 3, distinct: bool = False, parts: int = PARTS, similarity: float | None = None,
                tile_rows: int = TILE_ROWS) -> DataFrame:
    """doc_id, fp, n_shingles, component_id (smallest doc_id reachable) for every row of `docs`.

    With `similarity`, documents link only if their numbers of shingles allow that similarity.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    marked = written(fingerprints(slim, "_text", width, words, distinct).select("doc_id", "fp", "n_shingles"), "fps")
    node = node_of(similarity)
    nodes = marked.groupBy(node.alias("node")).agg(
        F.min("doc_id").alias("least_id"), F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes, words, radius, parts, similarity, tile_rows))
    rooted = written(nodes.join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root")), "roots")
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n")), "least")
    # written, so that the last join reads two plain tables and Spark can split a fingerprint that many rows share
    named = written(join_groups(rooted, least, "root", "n", rooted.count()).select("node", "component_id"), "components")
    return marked.withColumn("node", node).join(named, "node").select("doc_id", "fp", "n_shingles", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, words: int = 1,
             radius: int = 3, distinct: bool = False, parts: int = PARTS, similarity: float | None = None,
             tile_rows: int = TILE_ROWS) -> DataFrame:
    """One row of each group of near copies, whatever its ids are: the smallest by doc_id (nulls last), then digest of the text.

    Units are pairs of id and text, so an id on different texts, or none, is not one document. Of rows equal in both, the
    one whose other columns are smallest as JSON stays. Only the units to drop, or to make single, meet the documents, in one
    shuffle of the texts that builds a table of these few units in each task, at every size: the marks grow with the corpus, so
    whether they could be broadcast is not left to how small the input happens to be.
    """
    digest = F.md5(F.col(text))
    slim = docs.select(F.col(doc_id).alias("doc_id"), digest.alias("digest"), F.col(text).alias("_text"))
    marked = fingerprints(slim, "_text", width, words, distinct).drop("_text").withColumn("node", node_of(similarity))
    units = written(marked.groupBy("doc_id", "digest", "node").agg(
        F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n")), "units")
    unit = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    nodes = written(units.groupBy("node").agg(
        F.min(unit).alias("least"), F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles")), "nodes")
    roots = components(links(nodes, words, radius, parts, similarity, tile_rows))
    rooted = written(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "roots")
    heads = written(rooted.groupBy("root").agg(F.min("least").alias("head"), F.count("*").alias("n")), "least")
    named = written(join_groups(rooted, heads, "root", "n", rooted.count()).select("node", "head"), "heads")
    key, value, stays, again = fresh(docs, "_key", "_digest", "_head", "_again")
    marks = units.join(named, "node").select("doc_id", "digest", (unit == F.col("head")).alias("stays"), (F.col("n") > 1).alias("again"))
    marks = written(marks.filter(~F.col("stays") | F.col("again")).toDF(key, value, stays, again), "marks")
    same = F.col(doc_id).eqNullSafe(F.col(key)) & digest.eqNullSafe(F.col(value))
    kept = docs.join(marks.hint("shuffle_hash"), same, "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter(~F.coalesce(F.col(again), F.lit(False))).select(*columns)
    if marks.filter(F.col(stays) & F.col(again)).isEmpty():
        return once
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    first = kept.filter(again).groupBy(key, value).agg(F.min_by(F.struct(*columns), rest).alias(stays))
    return once.unionByName(first.select(f"{stays}.*"))
