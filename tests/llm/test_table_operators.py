"""kNN join, shards, url cascade, language fusion, mixing and SimHash against brute force."""

import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cilake.llm import knn, langid, mixing, shards, simhash, urlfilter

SF = "/root/testdata/sf0.001"


def brute_knn(rows, k):
    ok = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 50 == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, hot, law", [(400, 0, {}), (600, 300, {"group_queries": 2, "task_rows": 40, "n_pivots": 16}), (4, 0, {}), (0, 0, {})])
def test_knn(spark, n, hot, law):
    rng = random.Random(n)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(n)]
    rows = [(k, [0.5] * 8) if k < hot else (k, v) for k, v in rows]
    rows += [(10_000, None), (10_050, [None] * 8), (10_100, [float("nan")] * 8), (None, [1.0] * 8), (10_150, [float("inf")] * 8)]
    rows += [r for r in rows[:3] if r[0] % 50]  # repeated rows
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    got = knn.knn_join(data.filter("vec_id % 50 = 0"), data, 5, factor=256.0, **law)
    assert sorted(map(tuple, got.collect())) == brute_knn(rows, 5)


def test_knn_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(7)
    centers = rng.normal(0, 4, (12, 6))
    rows = [(k, (centers[k % 12] + rng.normal(0, 0.1, 6)).tolist()) for k in range(1200)]
    data = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in data.collect()]
    got = knn.knn_join(data.filter("vec_id % 50 = 0"), data, 5, factor=256.0, group_queries=4, n_pivots=32)
    assert sorted(map(tuple, got.collect())) == brute_knn(rows, 5)


@pytest.mark.parametrize("copies", [0, 2000])
def test_shards(spark, copies):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randrange(200)) for k in range(3000)] + [(5000 + k, "hot") for k in range(copies)]
    rows += [(None, None), (7, None), (7, None)] + [(9999, "same")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = shards.shard(shards.measured(docs), 10, fine_rows=100).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(size) == set(range(10)) and max(size.values()) - min(size.values()) < 3 * 216


def test_shards_small_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, shard string, _key int")
    assert shards.shard(shards.measured(empty), 40).count() == 0
    one = spark.createDataFrame([(1, "a", "old", 2)], empty.schema)
    got = shards.shard(shards.measured(one), 40).first()
    assert got.slot == 0 and got["_key"] == 2 and isinstance(got.shard, int)


def test_url_cascade(spark):
    rng = random.Random(2)
    urls = [f"https://Host{rng.randrange(300)}.Example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr', ''])}/{rng.randrange(40)}{rng.choice(['', '?q', '#f'])}"
            for _ in range(4000)] + [None, "", "no scheme", "x://", "ftp://A.b?c", "https://net/", "http://a.net", "http://anet/", "https://org/fr/x"]
    rows = [(k, u, k % 7 == 0) for k, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, bad boolean")

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        tail = rest[end:]
        cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        return rest[:end].lower(), tail[:cut]

    listed = {"".join(parts(u)) for _, u, bad in rows if bad and parts(u)[0]}
    want = {}
    for k, u, _ in rows:
        host, path = parts(u)
        fits = [(h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0])) if fits else (None, "block" if host + path in listed else "allow")
        want[k] = (host, path, rule, verdict)
    got = urlfilter.judge(pages, F.col("bad"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == want
    assert urlfilter.judge(pages.limit(0), F.col("bad")).count() == 0
    assert urlfilter.judge(pages, F.lit(None).cast("boolean")).filter("verdict = 'block' and rule is null").count() == 0
    clash = pages.withColumns({"host": F.lit(1), "_key": F.lit(2)})
    assert urlfilter.judge(clash, F.col("bad")).filter("host = 'a.b'").first()["_key"] == 2


def test_url_list_beyond_the_bound(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h.com/{k % 50}", k % 50 < 9) for k in range(200)], "page_id bigint, url string, bad boolean")
    want = {r.page_id: r.verdict for r in urlfilter.judge(pages, F.col("bad")).collect()}
    monkeypatch.setattr(urlfilter, "MAX_BITS", 0)
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages, F.col("bad")).collect()} == want
    assert Counter(want.values()) == {"block": 36, "allow": 164}


def test_language_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_text(docs.withColumn("lang", F.when(F.col("doc_id") > 3, F.col("lang"))))
    assert model.languages == ["de", "en", "es", "fr"]
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = langid.identify(pages, model).collect()
    declared = [r for r in got if r.declared]
    assert len(got) == pages.count() and sum(r.language == r.declared for r in declared) >= 0.97 * len(declared)
    body = "<html lang='{}'><body>{}</body></html>"
    german = docs.filter("lang = 'de' and n_chars > 500").first().text
    rows = [(k, "http://a.de/", body.format("de", german)) for k in range(30)]
    rows += [(100, "http://a.de/x", None), (101, None, ""), (102, "http://b.com/", body.format("fr", german)), (102, "http://b.com/", body.format("fr", german))]
    got = langid.identify(spark.createDataFrame(rows, "page_id bigint, url string, html string"), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[100].language == "de" and by[100].text_language is None
    assert by[102].language == "de" and all(0 < r.probability <= 1 + 1e-9 for r in got)


def test_language_without_training(spark):
    none = langid.fit_text(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id bigint, text string, lang string"))
    pages = spark.createDataFrame([(1, "http://a.de", "<p>x")], "page_id bigint, url string, html string")
    assert langid.identify(pages, none).first().language is None
    model = langid.TextModel(["a", "b"], np.ones((2, 1 << langid.BUCKET_BITS)))
    assert langid.identify(pages.limit(0), model).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    want, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = want - sum(2 * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]} - capped
        if not over:
            return target
        capped |= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(30)), rng.choice(["a", "b", "B", "é", "zz", None, "a", "a"]), 1) for k in range(3000)]
    rows += [(9000, None, "a", 1), (9001, "x y", "tiny", 1), (9002, None, "none", 1), (None, "x", "a", 1), (5, "p q", "b", 1), (5, "p q", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    got = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    target, taken = brute_targets(sizes), Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r["size"] == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.12 * target[s] + 40 for s in sizes)
    again = Counter(map(tuple, mixing.mix(docs).collect()))
    assert again == Counter({tuple(r): 0 for r in rows}) + Counter(
        x for r in got for x in [(r.doc_id, r.text, r.source, 1)] * r.copies)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_language_sample_and_long_pages(spark):
    """Rows of one id in two languages train their own language; a hot text counts once; pages are read in linear time."""
    rows = [(1, f"der hund und die katze {k}", "de") for k in range(30)] + [(1, f"the dog and the cat {k}", "en") for k in range(30)]
    rows += [(2, "the hot text", "en")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.sample(docs, "lang", "text", 20).collect()
    assert Counter(r.lang for r in got) == {"de": 20, "en": 20} and len({r.text for r in got}) == 40
    assert Counter(r.lang for r in langid.sample(docs, "lang", "text", 1000).collect()) == {"de": 30, "en": 31}
    model = langid.fit_text(docs)
    best = lambda t: model.languages[int(np.argmax(model.score(t)))]
    assert best("die katze und der hund") == "de" and best("the cat and the dog") == "en"
    for unit in ("<", "<!--", "<script>", "<nav ", "</script ", "<html "):
        page = unit * (10_000_000 // len(unit))
        start = time.perf_counter()
        langid.visible_text(page)
        assert time.perf_counter() - start < 20, unit
    assert langid.visible_text("a<script>x</script>b<!-- c --><b>d</b>&amp; <style>e < f") == "a b d & e < f"
    long = "abc " * 40_000
    whole = np.concatenate(list(langid.trigrams(long)))
    assert len(whole) == len(long) and (whole[:-5] == whole[4:-1]).all()
    assert model.score(long) == pytest.approx(model.table[:, whole].sum(axis=1).tolist())


def brute_posterior(seen, model, weight=0.1, drawn=5.0, smooth=0.5):
    """Languages and probabilities of evidence rows, by loops."""
    n, out = len(model.languages), []
    for r in seen:
        others = [x for x in seen if x is not r and x.guess is not None]
        count = lambda k, **same: sum(x.guess == k and all(x[c] == v for c, v in same.items()) for x in others)
        logs = []
        for k in range(n):
            prior = (count(k) + smooth) / (len(others) + smooth * n)
            for same in ({"domain": r.domain}, {"host": r.host}):
                prior = (count(k, **same) + drawn * prior) / (sum(count(j, **same) for j in range(n)) + drawn)
            fits = [(count(k, **{c: r[c]}) + smooth) / (count(k) + smooth * len({x[c] for x in seen})) for c in ("declared", "suffix")]
            logs.append(np.log(prior) + sum(np.log(fits)) + weight * r.text_score[k])
        share = np.exp(np.array(logs) - max(logs))
        out.append((r.page_id, model.languages[int(np.argmax(logs))], 1 / share.sum()))
    return sorted(out)


def test_language_posterior(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit_text(docs, rows=40)
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(120).select("page_id", "url", "html")
    odd = spark.createDataFrame([(9001, None, None), (9002, "https://a.b.de/x", "<html lang=fr>"), (9003, "no address", "<p>der hund</p>")], pages.schema)
    pages = pages.unionByName(odd)
    got = sorted((r.page_id, r.language, r.probability) for r in langid.identify(pages, model).collect())
    want = brute_posterior(langid.evidence(pages, model, "page_id", "url", "html").collect(), model)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def brute_simhash(rows, width=3, radius=3):
    prints = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        grams = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or [b" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("tile_rows, parts", [(1024, 4), (3, 2), (20, 0)])
def test_simhash_groups(spark, tile_rows, parts):
    rng = random.Random(8)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(rng.choice([1, 2, 5, 80]))) for _ in range(120)]
    texts = [None, "", " \n", "A b C", "a B c", *base]
    for t in base[:40]:  # near copies and chains of near copies
        words = t.split()
        for _ in range(3):
            words = [*words]
            words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_groups(docs, tile_rows=tile_rows, parts=parts).collect()
    assert {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in got} == brute_simhash(rows)


def test_simhash_hot_groups_and_ids(spark):
    rows = [(k, "one two three four five") for k in range(500)] + [(None, "one two three four five"), (None, "lonely text here"), (3, "one two three four five")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id is not None} == {0}
    assert sorted((r.component_id for r in got if r.doc_id is None), key=str) == [0, None]
    assert sorted((r.doc_id for r in simhash.keep_one(docs).collect()), key=str) == [0, None]
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_keep_one_keeps_a_row_of_every_group(spark):
    x, y, z = ("alpha beta gamma delta epsilon", "one two three four five", "red green blue white black")
    lone = [f"{k} lonely text {k * k} of its own {k * 7}" for k in range(30)]
    rows = [(5, x, "a"), (5, y, "b"), (3, y, "c"), (None, z, "d"), (8, z, "e"), (None, z, "f"), (7, x + " zeta", "h"), (7, x + " zeta", "g")]
    rows += [(None, t, "n") for t in lone] + [(None, lone[0], "m")]
    got = [tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()]
    want = [(5, x, "a"), (3, y, "c"), (8, z, "e"), (7, x + " zeta", "g"), (None, lone[0], "m")] + [(None, t, "n") for t in lone[1:]]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.keep_one(spark.createDataFrame([(None, None), (None, ""), (1, None)], "doc_id bigint, text string")).count() == 1


def test_wide_fingerprints_tell_similarity(spark):
    rng = random.Random(9)
    rows, near = [], []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(300)]
        rows.append((k, " ".join(words)))
        if k % 2:
            for at in rng.sample(range(300), 4):  # about 20 of 296 shingles change: similarity 0.87
                words[at] = "changed"
            near.append((1000 + k, " ".join(words)))
        else:
            rows.append((2000 + k, " ".join(words[:150] + ["".join(rng.choice("qrstuvw") for _ in range(6)) for _ in range(150)])))
    docs = spark.createDataFrame(rows + near, "doc_id bigint, text string")
    how = {"width": 5, "words": 16, "radius": 170, "distinct": True, "parts": 0, "similarity": 0.8}
    assert sorted(r.doc_id for r in simhash.keep_one(docs, **how).collect()) == sorted(i for i, _ in rows)


def test_links_contract_inside_tiles():
    """A group over many tiles passes on links between heads only."""
    rng = np.random.default_rng(4)
    flips = np.uint64(1) << rng.integers(0, 64, (1200, 1)).astype(np.uint64)
    nodes = np.unique(np.uint64(0x0F0F0F0F12345678) ^ flips, axis=0)
    nodes = np.concatenate([nodes, np.uint64(0x0F0F0F0F12345678) ^ (flips[:200] | np.roll(flips[:200], 1, axis=0))])
    packed = nodes.astype(">u8").tobytes()
    heads = simhash.tile_heads(packed, 1, 3, None)
    assert (heads == 0).all()
    assert simhash.tile_links(packed, heads, packed, heads, 1, 3, None) == [(packed[:8], packed[:8])]


def test_components(spark):
    rng = random.Random(10)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(50)]
    edges = spark.createDataFrame([(f"{a:05d}".encode(), f"{b:05d}".encode()) for a, b in pairs], "a binary, b binary")
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {int(bytes(r.node)): int(bytes(r.root)) for r in simhash.components(edges).collect()}
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
