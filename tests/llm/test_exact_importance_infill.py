"""Exact dedup, importance resampling and fill-in-middle against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Regex, pre_tokenizers

from pyspark.sql import functions as F

from cilake.llm import exact, importance, infill

DOCS = "doc_id bigint, text string"


def lowered(text):
    return (text or "").encode().lower().decode()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact dedup

def brute_dedup(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, best[lowered(t)], len(groups[lowered(t)]), sha(lowered(t))) for i, t in rows)


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, (20_000, 4), dtype=np.int64).astype(np.uint64)
    levels, slots = exact.build(words)
    assert sorted(slots.tolist()) == list(range(len(words)))
    assert (exact.look_up(words, levels) == slots).all()
    assert sum(int(b.sum()) for b in levels) == len(words)
    assert exact.look_up(words[:0], levels).tolist() == [] and exact.build(words[:0])[0] == []
    with pytest.raises(ValueError):
        exact.build(np.repeat(words[:1], 2, axis=0))


@pytest.mark.parametrize("segment_keys", [65_536, 16])
def test_dedup(spark, segment_keys):
    rng = random.Random(5)
    texts = [None, "", "A", "a", "É", "é", "x" * 300_000, *(f"Text {k}" for k in range(150))]
    rows = [(rng.choice([None, *range(400)]), rng.choice(texts)) for _ in range(900)]
    rows += [(k, "HOT text") for k in range(1000, 1600)] + [(7, "same")] * 5 + [(None, "no id")] * 4 + [(8, "Two"), (8, "tWO")]
    rng.shuffle(rows)
    old, new = rows[:700], rows[700:]
    frame = lambda r: spark.createDataFrame(r, DOCS)
    got = exact.dedup(frame(new), frame(old), segment_keys=segment_keys).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute_dedup(rows)
    kept = defaultdict(list)
    for r in got:
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text_sha256].append(r)
    assert set(kept) == {r.text_sha256 for r in got} and all(len(k) == 1 for k in kept.values())


def test_dedup_empty_sides_and_clashing_names(spark):
    rows = [(1, "a", "x", 5), (2, "A", "y", 6), (3, None, "z", 7)]
    full = spark.createDataFrame(rows, "doc_id bigint, text string, Keep_Id string, extra int")
    none = full.filter("false")
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    for new, old in ((full, none), (none, full)):
        got = exact.dedup(new, old)
        assert got.columns == ["doc_id", "extra", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    assert exact.dedup(none, none).collect() == []


def test_history_lookup_checks_bytes(spark):
    """Only members of the index get a slot, and each slot is met once."""
    frame = lambda r: spark.createDataFrame(r, DOCS)
    old = exact.distinct_digests(exact.marked(frame([(k, f"old {k}") for k in range(300)]), 1), 3)
    new = exact.distinct_digests(exact.marked(frame([(k, f"old {k}") for k in range(200, 500)]), 0), 3)
    got = exact.merged(new, exact.index(old)).collect()
    assert Counter((r.slot is not None, r.old is not None, r.new is not None) for r in got) == {
        (True, True, True): 100, (True, True, False): 200, (False, False, True): 200}


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, max_run, buckets):
    words = WORD.findall(lowered(text))
    runs = [" ".join(words[i : i + k]) for k in range(1, max_run + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def brute_resample(rows, target, max_run, buckets, percent, min_words):
    found = [brute_features(t, max_run, buckets) for _, t in rows]
    s, t = sum((m for _, m in found), Counter()), sum((brute_features(x, max_run, buckets)[1] for x in target), Counter())
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for (i, _), (words, met) in zip(rows, found, strict=True):
        h = int(sha(f"2024:{'null' if i is None else i}")[:8], 16)
        weight = sum(gain[b] * n for b, n in met.items())
        out.append([i, words, met.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    eligible = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: len(eligible) * percent // 100], 1):
        r[5] = k
    return Counter(map(tuple, out))


@pytest.mark.parametrize("max_run, min_words", [(1, 3), (3, 1)])
def test_resample(spark, max_run, min_words):
    rng = random.Random(max_run)
    vocabulary = ["alpha", "BETA", "straße", "Éa", "x9", "été", "_", "<b>", "na\x00me", "日本", "a-b"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "  ", ".", ""]) for _ in range(n))
    rows = [(k, text(rng.randrange(12))) for k in range(300)] + [(None, text(9))] * 3 + [(5, text(8)), (9, None), (10, ""), (11, text(9000))]
    rows += [(400, "beta beta alpha")] * 4 + [(12, "y" * 50_000), (13, "é" * 9000 + " z")]
    target = [text(30), None, "", "beta beta"]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    law = {"max_run": max_run, "buckets": 97, "percent": 40, "min_words": min_words}
    got = importance.resample(docs, goal, **law)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got.collect()) == brute_resample(rows, target, **law)


def test_resample_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2), (2, "d e f", 3, 4)], "doc_id bigint, text string, Rank int, at int")
    got = importance.resample(docs, docs.filter("false"), percent=100, min_words=1)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in got.collect()) == [1, 2]
    assert importance.resample(docs.filter("false"), docs).collect() == []


@pytest.mark.parametrize("block", [1, 7, 2048])
def test_blocks_cut_no_word(monkeypatch, block):
    monkeypatch.setattr(importance, "BLOCK_BYTES", block)
    split = pre_tokenizers.Split(Regex(importance._BREAK + "+"), behavior="removed")
    rng = random.Random(block)
    for _ in range(200):
        text = "".join(rng.choice("ab é日.\n\x00_") for _ in range(rng.randrange(40)))
        words, met = importance.feature_counts(lowered(text).encode(), 2, 50, split)
        assert (words, met) == brute_features(text, 2, 50)


# fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infill(doc_id, text):
    text = text or ""
    x = sha(f"42:{'null' if doc_id is None else doc_id}")
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    cut = UNIT.findall(text)
    a, b = sorted(v % (len(cut) + 1) for v in h[:2])
    prefix, middle, suffix = "".join(cut[:a]), "".join(cut[a:b]), "".join(cut[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(cut), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(cut), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(cut), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice(["ab", " ", "\n", "\t ", "é", "<", "<P", "S>", "\x0b", " ", "日本"]) for _ in range(n))
    rows = [(k, text(rng.randrange(30))) for k in range(400)] + [(None, "a b c"), (None, None), (1, None), (2, ""), (3, "  "), (4, " a ")]
    rows += [(5, "with <M> inside")] * 2 + [(k, text(400_000)) for k in range(500, 504)]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], DOCS + ", extra string, FORM int")
    made = infill.restore(infill.transform(docs))
    assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = made.collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == Counter(brute_infill(*r) for r in rows)
    assert all(r.restored == (r.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.restore(infill.transform(docs.filter("false"))).collect() == []


def test_restore_of_foreign_output():
    got = infill.rebuilt(pa.array(["x", "<P>a<S>b<M>c", "<S>a<P>b<M>c", None, "q", "t"]), pa.array(["psm", "psm", "spm", "spm", None, "plain"]))
    assert got.to_pylist() == [None, "acb", "bca", None, None, "t"]


def test_infill_keeps_large_texts_that_follow_others_in_a_batch(spark):
    texts = ["<P>" + piece * 1_500_000 for piece in ("w ", "  ", "é", "a\n")] + ["a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    made = infill.restore(infill.transform(docs)).filter("doc_id < 4").select("doc_id", F.sha2("text", 256).alias("want"),
                                                       F.sha2("output", 256).alias("output"), F.sha2("restored", 256).alias("restored"))
    assert all(r.want == r.output == r.restored for r in made.collect())
