"""Quality bands, licence scan, byte-pair coding and toxicity against plain Python."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from cilake.llm import bpe, licenses, quality, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"
ODD = [None, "", " ", "\n\n \t", "a", "é" * 60, "x y z " * 40, "word " * 49, " ".join(f"w{k}" for k in range(60)),
       "Zeile\x0beins\x0czwei\x1cdrei\x85vier\u00a0fünf", "long " * 30000, "=" * 3000, "ab" * 4000]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed)


def test_quality_base_columns(spark):
    rows = [(k, t) for k, t in enumerate(ODD + ["a b c\na b c\n\nd e\nd e\n#*$ |"])]
    got = quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: tuple(r)[2:8] for r in got} == {k: brute_quality(t) for k, t in rows}
    assert not any(r.kept and r.base_failed for r in got)


def test_quality_driver_rows_and_bands(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for r in docs.collect():
        g, data = got[r.doc_id], r.text.encode()
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_quality(r.text)
        assert g.ratio == len(squeeze(data)) / len(data)
        low, high = [b[1:] for b in quality.BANDS if b[0] <= len(data)][-1]
        assert not g.kept or low <= g.ratio <= high
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1")
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(labels, "doc_id")
    judged = quality.assess(good).filter("not base_failed")
    assert judged.filter("kept").count() >= 0.98 * judged.count()
    noise = "".join(random.Random(3).choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ") for _ in range(5000))
    assert not quality.assess(spark.createDataFrame([(1, noise)], SCHEMA)).first().kept


def test_quality_clashing_names_and_empty(spark):
    rows = spark.createDataFrame([(1, "t", "x", 5)], "doc_id bigint, text string, kept string, _judged int")
    got = quality.assess(rows)
    assert got.columns.count("kept") == 1 and dict(got.dtypes)["kept"] == "boolean" and got.first()["_judged"] == 5
    assert quality.keep_good(rows).columns == rows.columns
    assert quality.assess(rows.limit(0)).count() == 0


def brute_licenses(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words))
              if words[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_places(spark):
    texts = [*ODD, "MIT License. mit license, MIT-LICENSE mit licenses", "the apache license version 2.0 CC BY-NC CC BY",
             "GNU General Public License, version 3", "cc by cc by cc by", "ÉMIT License", "commit license mit\n\nlicense"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in licenses.scan_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(r.text)


def test_license_expressions():
    assert licenses.postfix("mit or apache-2.0 and gpl-2.0") == ["mit", "apache-2.0", "gpl-2.0", "and", "or"]
    assert licenses.postfix("(mit or isc) and gpl-3.0 with gcc-exception-3.1") == ["mit", "isc", "or", "gpl-3.0", "gcc-exception-3.1", "with", "and"]
    assert licenses.evaluate("mit or gpl-3.0") == ({"mit", "gpl-3.0"}, 0.9)
    assert licenses.evaluate("mit and gpl-3.0-or-later") == ({"mit", "gpl-3.0-or-later"}, 0.4)
    assert licenses.evaluate("gpl-2.0-only with classpath-exception-2.0")[1] == pytest.approx(0.6)
    assert licenses.evaluate("no-such-licence")[1] == 0
    for bad in ("", "mit or", "mit apache-2.0", "(mit", "mit)", "and mit", "()"):
        with pytest.raises(ValueError):
            licenses.postfix(bad)
    search = licenses.automaton()
    tagged = licenses.scan(b"/* SPDX-License-Identifier: MIT OR (GPL-2.0 AND */\ncode\n// SPDX-License-Identifier: ISC", search)
    assert tagged[5] == "invalid-expression,isc" and tagged[8] == 0


def test_license_tags_on_one_line(spark):
    search = licenses.automaton()
    many = licenses.scan(b"SPDX-License-Identifier: MIT SPDX-License-Identifier: ISC or MIT\nSPDX-License-Identifier: GPL-2.0", search)
    assert many[6] == ["mit", "isc or mit", "gpl-2.0"] and many[5] == "gpl-2.0,isc,mit"
    data = b"SPDX-License-Identifier: MIT " * (4_000_000 // 29)
    start = time.perf_counter()
    got = licenses.scan(data, search)
    assert time.perf_counter() - start < 30 and got[5] == "mit" and sum(map(len, got[6])) < len(data)
    chain = licenses.evaluate(" or ".join(f"l{k}" for k in range(100_000)))
    assert len(chain[0]) == 100_000
    docs = spark.createDataFrame([(1, "MIT License", 5, "x")], SCHEMA + ", Score int, n_words string")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "text", *(n for n, _, _ in licenses.FIELDS)] and out.first().labels == "mit"
    assert licenses.scan_licenses(docs.filter("false")).collect() == []


@pytest.fixture(scope="module")
def reference():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, reference):
    rng = random.Random(5)
    texts = [*ODD, "<|endoftext|> it's I'LL we've", "".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(3000)),
             "".join(rng.choice(" \n\t\x1c\x85\u3000a's中0\u0300\u200b😀") for _ in range(3000))]
    rows = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.digest(rows, path, public_tokenizers.PATTERN).collect()
    for r in got:
        text = texts[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(r.ids == reference.encode_ordinary(r.text) for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect())


def test_bpe_long_piece_and_cache(reference):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    run = bpe.Encoder(tokens, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for _ in range(5):
        piece = "".join(rng.choice("abcdeth") for _ in range(1500))
        assert bpe.merge_long(run.table, piece.encode()).tolist() == reference.encode_ordinary(piece)
    texts = ["alpha beta", "beta gamma alpha", ""]
    for _ in range(2):
        ids, ends = run(texts)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [reference.encode_ordinary(t) for t in texts]
        run._reset()


def test_bpe_decode_nulls_and_bad_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "k int, ids array<int>")
    got = {r.k: bytes(r.data) for r in bpe.decode(rows, path).collect()}
    tokens = bpe.read_ranks(path)
    assert got == {1: b"", 2: b"", 3: tokens[0] + tokens[1]}
    with pytest.raises(ValueError):
        bpe.decode_ids(np.array([99999999]), np.zeros(0, np.uint8), np.zeros(3, np.int64))


def test_quality_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1")
    squeeze, rng = zstandard.ZstdCompressor(level=quality.LEVEL).compress, random.Random(12)
    for lang in ("de", "fr"):
        texts = sorted({r.text for r in docs.filter(docs.lang == lang).join(good, "doc_id", "left_semi").collect()})
        rng.shuffle(texts)
        joined = "\n".join(texts).encode()
        words = joined.split()
        pairs = [b" ".join(words[k : k + 2]) for k in range(len(words) - 1)]
        longer = b" ".join(rng.choices(pairs, k=2_400_000))
        for data, size in ((joined, 1 << 19), (joined, 1 << 20), (longer, 1 << 22), (longer, 1 << 24)):
            assert len(data) >= size
            judged = quality.judge(data[:size].decode(errors="ignore").encode(), squeeze)
            assert judged[-1], (lang, size, judged)
        assert not quality.judge(joined[:50_000].decode(errors="ignore").encode() * 20, squeeze)[-1]


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    chain = toxicity.fit(docs, labels.filter(~held))
    got = toxicity.score(docs.join(labels.filter(held), "doc_id"), chain).collect()
    clean, toxic = [r for r in got if not r.toxic], [r for r in got if r.toxic]
    assert sum(r.is_toxic for r in clean) <= 0.01 * len(clean)
    assert sum(r.is_toxic for r in toxic) >= 0.8 * len(toxic)
    assert all(0 <= p <= 1 for r in got for p in (r.p_insult, r.p_contempt, r.p_toxic))
    assert chain.models[1][1].shape == (1,) and chain.models[2][1].shape == (2,)
    odd = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)], "doc_id bigint, text string, p_toxic string")
    assert toxicity.score(odd, chain).count() == len(ODD) and toxicity.keep_clean(odd, chain).columns == odd.columns


def test_toxicity_of_long_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    chain = toxicity.fit(docs, labels.filter(~held))
    got = toxicity.score(docs.join(labels.filter(held), "doc_id"), chain).orderBy("doc_id").collect()
    scorer, passage = toxicity.Scorer(chain), " trash idiot moron worthless stupid pathetic clown "
    for lang in ("de", "en", "es", "fr"):
        clean = [r.text or "" for r in got if r.lang == lang and not r.toxic and not r.is_toxic]
        for n in (10_000, 100_000):
            words = " ".join(clean * (1 + n // 10_000)).split(" ")[:n]
            assert len(words) == n
            assert scorer(" ".join(words).encode())[-1] < toxicity.THRESHOLD, (lang, n)
            half = [" ".join(words[: n // 2]), " ".join(words[n // 2 :])]
            assert scorer(passage.join(half).encode())[-1] >= toxicity.THRESHOLD, (lang, n)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r.p_toxic for r in toxicity.score(docs, none).collect()] == pytest.approx([0, 0], abs=1e-9)
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "doc_id bigint, toxic int"))
    assert toxicity.score(docs, one).filter("is_toxic").count() == 2
