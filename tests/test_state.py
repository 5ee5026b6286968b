"""Key/value files, env as of a step, PATH, matrices, files, templates."""

import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from cilake.functions.text import glob_to_regex, normal_glob
from cilake.operators import envstate as es
from cilake.operators import files as fs
from cilake.operators import matrix as mx
from cilake.operators import templates as tp
from cilake.sources import framing, kvfiles

KV = [
    # content, pairs or error
    ("CITY=Oslo\n", [("CITY", "Oslo")]),
    ("\nURL=x?y=z\r\n\r\nNIL=", [("URL", "x?y=z"), ("NIL", "")]),
    ("POEM<<__\nroses\nviolets\n__\n", [("POEM", "roses\nviolets")]),
    ("P<<__\r\nup\r\ndown\r\n__\r\nQ=2", [("P", "up\r\ndown"), ("Q", "2")]),
    ("P<<__\n__\nQ=3<<4", [("P", ""), ("Q", "3<<4")]),
    ("P<<__\n\n\n__", [("P", "\n")]),
    ("LOST<<__\nline", "delimiter not found"),
    ("LOST<<__\nline\n", "delimiter not found"),
    ("NODE_OPTIONS=--trace", "blocked name"),
    ("NODE_OPTIONS<<__\nx\n__\n", "blocked name"),
    ("Q=1\n=nameless", "name must not be empty"),
    ("<<__\nx\n__", "name and delimiter must not be empty"),
    ("Q<<\nx\n", "name and delimiter must not be empty"),
    ("Q=1\nno sign\nR=2", "invalid format"),
    ("Q<<__\n=x\n__\nno sign", "invalid format"),
    ("", []),
]


def test_kv_files(spark):
    df = spark.createDataFrame([(i, "env", c) for i, (c, _) in enumerate(KV)], "f int, kind string, content string")
    read = kvfiles.parse_kv_files(df)
    got = {}
    for r in read.filter("error is null").orderBy("f", "ord").collect():
        got.setdefault(r.f, []).append((r.key, r.value))
    bad = {r.f: r.error for r in read.filter("error is not null").collect()}
    for i, (content, want) in enumerate(KV):
        assert (bad.get(i) or got.get(i, [])) == want, content


def read_in_order(lines):
    """A reader line by line: pairs, or the first problem."""
    pairs, k = [], 0
    while k < len(lines):
        line, k = lines[k], k + 1
        if not line:
            continue
        eq, at = line.find("="), line.find("<<")
        if at >= 0 and (eq < 0 or at < eq):
            if at == 0 or not line[at + 2:]:
                return "name and delimiter must not be empty"
            if line[at + 2:] not in lines[k:]:
                return "delimiter not found"
            end = lines.index(line[at + 2:], k)
            pairs.append((line[:at], "\n".join(lines[k:end])))
            k = end + 1
        elif eq <= 0:
            return "invalid format" if eq < 0 else "name must not be empty"
        else:
            pairs.append((line[:eq], line[eq + 1:]))
    return pairs


def test_overlapping_heredocs(spark):
    rnd = random.Random(12)
    pool = ["A<<E", "B<<F", "C<<G", "E", "F", "G", "", "k=v", "k=E<<F"]
    files = [[rnd.choice(pool) for _ in range(rnd.randrange(1, 40))] for _ in range(100)]
    for _ in range(200):  # closed in the end, with other openers and closers within
        files.append([])
        for _ in range(rnd.randrange(1, 6)):
            d = rnd.choice("EFG")
            files[-1] += [f"K<<{d}", *[x for x in rnd.choices(pool, k=rnd.randrange(9)) if x != d], d, "k=v"]
    # a file that opens one heredoc after another, each within the span of the one before
    files.append(["A<<E", *[x for i in range(200) for x in (f"A<<d{i + 1}" if i % 2 else f"B<<d{i}", "E" if i % 7 == 0 else f"d{i}")], "E"])
    df = spark.createDataFrame([(i, "env", "\n".join(x)) for i, x in enumerate(files)], "f int, kind string, content string")
    got = {}
    for r in kvfiles.parse_kv_files(df).orderBy("f", "ord").collect():
        if r.error:
            assert r.f not in got
            got[r.f] = r.error
        else:
            got.setdefault(r.f, []).append((r.key, r.value))
    want = {i: read_in_order(x) for i, x in enumerate(files)}
    assert got == {i: w for i, w in want.items() if w}
    assert sum(isinstance(w, list) and len(w) > 1 for w in want.values()) > 20


def test_kv_round_trip(spark):
    values = [("A", "x"), ("B", "l1\nl2\n"), ("C", ""), ("D", "a=b<<c"), ("E", "\n")]
    df = spark.createDataFrame(values, "key string, value string")
    text = "".join(r.text for r in kvfiles.encode_kv_rows(df).collect())
    read = kvfiles.parse_kv_files(spark.createDataFrame([("env", text)], "kind string, content string"))
    pairs, errors = read.filter("error is null"), read.filter("error is not null")
    assert errors.count() == 0
    assert sorted((r.key, r.value) for r in pairs.collect()) == sorted(values)


def test_framing(spark):
    rnd = random.Random(5)
    texts = {i: "".join(rnd.choice("ab\n") for _ in range(rnd.randrange(0, 60))) for i in range(12)}
    chunks = []
    for s, t in texts.items():
        n, i = 0, 0
        while i < len(t):
            k = rnd.randrange(1, 9)
            chunks.append((s, n, t[i:i + k]))
            n, i = n + 1, i + k
    df = spark.createDataFrame(chunks, "stream bigint, seq bigint, chunk string")
    want = set()
    for s, t in texts.items():
        lines = t.split("\n")
        want |= {(s, i, x) for i, x in enumerate(lines) if not (i == len(lines) - 1 and x == "")}
    for block in (2, 65536):
        assert {tuple(r) for r in framing.frame_lines(df, block).collect()} == want


def test_env_asof(spark):
    writes = spark.createDataFrame([(1, 0, 0, "env", "A", "a0"), (1, 0, 1, "env", "A", "a1"), (1, 2, 0, "env", "A", "a2"), (1, 1, 0, "output", "A", "no")],
                                   "job_id bigint, step_idx bigint, ord bigint, kind string, key string, value string")
    initial = spark.createDataFrame([(1, "A", "init"), (1, "B", "b")], "job_id bigint, key string, value string")
    probes = spark.createDataFrame([(1, s, k) for s in range(4) for k in "AB"], "job_id bigint, step_idx bigint, key string")
    for block in (1, 65536):
        got = {(r.step_idx, r.key): r.value for r in es.env_asof_step(probes, writes, initial, block).collect()}
        assert got == {(0, "A"): "init", (1, "A"): "a1", (2, "A"): "a1", (3, "A"): "a2", **{(s, "B"): "b" for s in range(4)}}


def test_path_list(spark):
    df = spark.createDataFrame([(1, 0, "/a"), (1, 1, "/b"), (1, 2, "/a"), (1, 3, "")], "job_id bigint, ord bigint, entry string")
    assert es.path_list(df, "/usr/bin", block_rows=1).first().path == "/a:/b:/usr/bin"


def brute_matrix(dims, excludes, includes):
    if any(k not in dims for e in excludes for k in e):
        return "error"
    names = sorted(dims)
    combos = [dict(zip(names, vs)) for vs in itertools.product(*[dims[n] for n in names])] if dims else []
    combos = [c for c in combos if not any(all(c.get(k, v) == v for k, v in e.items()) for e in excludes)]
    extra = []
    for inc in includes:
        agree = [c for c in combos if all(c[k] == v for k, v in inc.items() if k in dims)]
        for c in agree:
            c.update(inc)
        if not agree:
            extra.append(dict(inc))
    return (combos + extra) or [{}]


def test_matrix_against_brute_force(spark):
    rnd = random.Random(11)
    jobs, dims, excl, incl, none, want = [], [], [], [], [], {}
    for job in range(40):
        d = {n: [f"{n}{i}" for i in range(rnd.randrange(0 if rnd.random() < .1 else 1, 4))] for n in rnd.sample(["a", "b", "c"], rnd.randrange(0, 4))}
        pick = lambda keys: {k: rnd.choice((d.get(k) or ["z"]) + ["z"] * (rnd.random() < .2)) for k in keys}
        ex = [pick(rnd.sample(sorted(d) + (["bad"] if rnd.random() < .1 else []), 1)) for _ in range(rnd.randrange(0, 3)) if d]
        inc = [{**pick(rnd.sample(sorted(d), rnd.randrange(0, len(d) + 1))), **{k: f"{k}{r}" for k in rnd.sample(["x", "y"], rnd.randrange(1, 3))}} for r in range(rnd.randrange(0, 4))]
        jobs.append((job,))
        dims += [(job, n, i, v) for n, vs in d.items() for i, v in enumerate(vs)]
        none += [(job,) for vs in d.values() if not vs]
        excl += [(job, i, k, v) for i, e in enumerate(ex) for k, v in e.items()]
        incl += [(job, i, k, v) for i, e in enumerate(inc) for k, v in e.items()]
        want[job] = brute_matrix(d, ex, inc)
    rule = "job_id bigint, rule_pos bigint, dim string, value string"
    # an empty dimension still is a dimension: it has no rows, so keys naming it are checked by hand here
    skip = {j for (j,) in none}
    df = lambda rows, schema: spark.createDataFrame([r for r in rows if r[0] not in skip], schema)
    out, errors = mx.expand_matrix(df(jobs, "job_id bigint"), df(dims, "job_id bigint, dim string, pos bigint, value string"), df(excl, rule), df(incl, rule))
    got = {}
    for r in out.collect():
        got.setdefault(r.job_id, {}).setdefault(r.combo, {}).update({r.dim: r.value} if r.dim else {})
    failed = {r.job_id for r in errors.collect()}
    canon = lambda cs: sorted(sorted(c.items()) for c in cs)
    for job, w in want.items():
        if job in skip:
            continue
        if w == "error":
            assert job in failed and job not in got
        else:
            assert canon(got[job].values()) == canon(w), job


def test_jobs_expand_in_their_rows_as_by_joins(spark, monkeypatch, capsys):
    rnd = random.Random(13)
    jobs, dims, excl, incl, none = [(None,), (3,), (3,)], [], [], [], []
    for job in [*range(60), None]:
        jobs += [(job,)] * (rnd.random() < .9)
        named = {n: [rnd.choice("uvw") + n if rnd.random() < .9 else None for _ in range(rnd.randrange(1, 4))] for n in rnd.sample("abc", rnd.randrange(0, 4))}
        dims += [(job, n, i, v) for n, vs in named.items() for i, v in enumerate(vs)]
        none += [(job,)] * (rnd.random() < .1)
        known = [*named, "bad"] if rnd.random() < .1 else [*named]
        pick = lambda keys: [(k, rnd.choice(named.get(k, []) + ["z"])) for k in keys]
        excl += [(job, r, k, v) for r in range(rnd.randrange(3)) for k, v in pick(rnd.sample(known, rnd.randrange(len(known) + 1)))]
        for r in rnd.sample(range(6), rnd.randrange(4)):
            own = [(k, rnd.choice([f"{k}{r}", None])) for k in rnd.sample("xyz", rnd.randrange(3))]
            incl += [(job, r, k, v) for k, v in pick(rnd.sample([*named], rnd.randrange(len(named) + 1))) + own]
    # odd jobs: a position twice or left out, a value of a key twice, a NULL key, a rule without a number
    dims += [(100, "a", 0, "u"), (100, "a", 0, "u"), (101, "a", 1, "u"), (102, None, 0, "u"), (102, "a", 0, "u"), (103, "a", None, "u"), (104, "a", 0, "u")]
    dims += [(105, d, i, f"{d}{i}") for d in "ab" for i in range(30)] + [(106, "a", i, f"a{i}") for i in range(1100)]
    excl += [(100, 0, "a", "w"), (104, 0, "a", "w"), (104, 0, "a", "u"), (105, 0, "a", "a3"), (106, 0, "a", "a7"), (107, 0, "a", "u"), (102, 0, None, "u")]
    incl += [(101, 0, "x", "1"), (104, 0, "x", "1"), (104, 0, "x", "1"), (105, 4, "b", "b9"), (105, 4, "x", "1"), (106, 0, "a", "a7"), (106, None, "x", "1"), (102, 0, None, "q")]
    jobs += [(j,) for j in range(100, 109)]
    df = lambda rows, schema: spark.createDataFrame(rows, f"job_id bigint, {schema}" if schema else "job_id bigint").repartition(3)
    rule = "rule_pos bigint, dim string, value string"
    tables = [df(jobs, ""), df(dims, "dim string, pos bigint, value string"), df(excl, rule), df(incl, rule), df(none, "")]
    canon = lambda out: sorted(map(repr, out.select("job_id", "combo", "dim", "value").collect()))
    out, errors = mx.expand_matrix(*tables)
    monkeypatch.setattr(mx, "IN_ROW", -1)
    assert canon(out) == canon(mx.expand_matrix(*tables)[0]) and len(canon(out)) > 1000
    assert {107, 102} <= {r.job_id for r in errors.collect()}
    # plain jobs need no join
    monkeypatch.undo()
    plain = [t.filter("job_id < 60") for t in tables]
    mx.expand_matrix(plain[0].distinct(), *plain[1:])[0].explain()
    assert "Join" not in capsys.readouterr().out


def test_kept_numbers_against_all_combinations(spark):
    rnd = random.Random(12)
    dims, excl, want = [], [], set()
    for job in range(30):
        sizes = [rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 5))]
        named = [(f"d{i}", [f"v{rnd.randrange(4)}" for _ in range(n)]) for i, n in enumerate(sizes)]  # values repeat
        rules = [{d: rnd.choice(vs + ["no"]) for d, vs in rnd.sample(named, rnd.randrange(1, len(named) + 1))} for _ in range(rnd.randrange(0, 6))]
        dims += [(job, d, i, v) for d, vs in named for i, v in enumerate(vs)]
        excl += [(job, r, d, v) for r, rule in enumerate(rules) for d, v in rule.items()]
        for combo, values in enumerate(itertools.product(*[vs for _, vs in named])):
            here = dict(zip([d for d, _ in named], values, strict=True))
            if not any(all(here[d] == v for d, v in rule.items()) for rule in rules):
                want.add((job, combo))
    dims = spark.createDataFrame(dims, "job_id bigint, dim string, pos bigint, value string")
    excl = spark.createDataFrame(excl, "job_id bigint, rule_pos bigint, dim string, value string")
    got = [tuple(r) for r in mx.kept_numbers(dims, excl).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    by_values = mx.matrix_exclude(mx.matrix_product(dims), excl, dims).select("job_id", "combo").distinct().collect()
    assert {tuple(r) for r in by_values} == want
    assert {tuple(r) for r in mx.kept_numbers(dims, excl, dims.filter("job_id < 10")).collect()} == {w for w in want if w[0] >= 10}


def test_excluded_combinations_never_unfold(spark):
    """10^12 combinations of which 10^4 are left: only these cost."""
    dims = [(1, d, i, f"{d}{i}") for d, n in (("a", 1000), ("b", 100), ("c", 1000), ("e", 10000)) for i in range(n)]
    excl = [(1, i, "a", f"a{i}") for i in range(1, 1000)] + [(1, 2000 + i, "c", f"c{i}") for i in range(1000) if i != 7]
    excl += [(1, 4000 + 2 * i, "b", f"b{i}") for i in range(99)]
    df = spark.createDataFrame(dims, "job_id bigint, dim string, pos bigint, value string")
    rules = spark.createDataFrame(excl, "job_id bigint, rule_pos bigint, dim string, value string")
    got = sorted(r.combo for r in mx.kept_numbers(df, rules).collect())
    assert got == [99 * 10**7 + 7 * 10**4 + e for e in range(10**4)]


def test_matrix_empty_dimension(spark):
    jobs = spark.createDataFrame([(1,)], "job_id bigint")
    dims = spark.createDataFrame([(1, "a", 0, "x")], "job_id bigint, dim string, pos bigint, value string")
    rules = spark.createDataFrame([], "job_id bigint, rule_pos bigint, dim string, value string")
    out, _ = mx.expand_matrix(jobs, dims, rules, rules, empty_dims=jobs)
    assert [(r.dim, r.value) for r in out.collect()] == [(None, None)]


def test_hash_files(spark):
    tree = {"a.txt": "1", "src/b.go": "22", "src/sub/c.go": "", "README": "x"}
    df = spark.createDataFrame([("g", p, c) for p, c in tree.items()], "g string, path string, content string")
    digest = lambda paths: hashlib.sha256(b"".join(hashlib.sha256(tree[p].encode()).digest() for p in sorted(paths))).hexdigest()
    assert fs.hash_files(df, ["g"]).first().hash == digest(tree)
    picked = fs.select_files(df, ["/**/*.go", "!src/sub/*"])
    assert fs.hash_files(picked, ["g"]).first().hash == digest(["src/b.go"])
    odd = [(g, p, c) for g in (None, float("nan"), 1.0, 2.0) for p, c in tree.items()]
    got = fs.hash_files(spark.createDataFrame(odd, "g double, path string, content string"), ["g"]).collect()
    assert len(got) == 4 and {r.hash for r in got} == {digest(tree)}
    gone = fs.hash_files(fs.select_files(df, ["nonexistent/*.xyz"]), ["g"])
    assert fs.hash_or_empty(df, gone, ["g"]).first().hash == ""


def test_one_meaning_of_globs(spark):
    paths = ["fr/a.md", "f/a.md", "r/a.md", "f[r]/a.md", "x/fr/a.md", "a+b.md", "fr/b.txt", "q.md"]
    files = spark.createDataFrame([(p, "s") for p in paths], "path string, set_id string")
    for globs in (["f[r]/*.md"], ["**/f[r]/*.md"], ["*.md", "!q.*"], ["**/*.md", "!**/fr/*"], ["/fr/?.md"], ["a+b.md"], ["[!f]*/a.md"], ["[^f]/a.md"], [r"f\[r\]/a.md"]):
        rules = spark.createDataFrame([("s", g) for g in globs], "set_id string, pattern string")
        want = sorted(r.path for r in fs.select_files(files, globs).collect())
        assert sorted(r.path for r in fs.select_by_rules(files, rules).collect()) == want, globs


def test_rules_of_paths_against_all_pairs(spark):
    rnd = random.Random(8)
    part = lambda: rnd.choice(["src", "lib", "a.b", "x", "t_test"])
    paths = sorted({"/".join([part() for _ in range(rnd.randrange(0, 4))] + [part() + rnd.choice([".go", ".md", ""])]) for _ in range(200)})
    glob = lambda: "/".join(rnd.choice(["src", "lib", "**", "*", "a.?", "[sl]*", "x"]) for _ in range(rnd.randrange(0, 3)))
    globs = sorted({rnd.choice(["", "", "!", "/"]) + "/".join(filter(None, [glob(), rnd.choice(["*.go", "*.md", "*_test.go", "x", "[a-x]*", "?"])]))
                    for _ in range(120)})
    files = spark.createDataFrame([(s, p) for p in paths for s in "st"], "set_id string, path string")
    rules = spark.createDataFrame([(s, g) for i, g in enumerate(globs) for s in "st" if s == "s" or i % 3], "set_id string, pattern string")
    got = {(r.set_id, r.path) for r in fs.select_by_rules(files, rules).collect()}
    regexes = {g: re.compile(glob_to_regex(normal_glob(g.removeprefix("!")))) for g in globs}

    def chosen(p, some):
        hits = [g.startswith("!") for g in some if regexes[g].search(p)]
        return bool(hits) and not any(hits)

    want = {("s", p) for p in paths if chosen(p, globs)} | {("t", p) for p in paths if chosen(p, [g for i, g in enumerate(globs) if i % 3])}
    assert want and got == want


def test_long_heredoc_files(spark):
    text = "A<<E\n" + "line\r\n" * 100_000 + "E\n" + "".join(f"K{k}=v\n" for k in range(50_000)) + "B<<E\nE\n"
    got = kvfiles.parse_kv_files(spark.createDataFrame([("env", text)], "kind string, content string"))
    assert got.count() == 50_002 and got.filter("key = 'A'").first().value == "line\r\n" * 99_999 + "line"


def test_template_values(spark):
    d = "$"
    cases = [("'lit'", "lit", None), ("'it''s'", "it's", None), ("A['b']", "V", None), ("a.b", "V", None), ("true", "true", None), ("-1.5", "-1.5", None),
             ("null", "", None), ("a[0].c", "W", None), ("a == b", None, "no value: a == b"), ("f('x')", None, "no value: f('x')"), ("", None, "no value: ")]
    t = spark.createDataFrame([(k, f"{d}{{{{ {body} }}}}") for k, (body, _, _) in enumerate(cases)], "tpl_id bigint, template string")
    c = spark.createDataFrame([(1, k, p, v) for k in range(len(cases)) for p, v in (("a.b", "V"), ("a[0].c", "W"))], "ctx_id bigint, tpl_id bigint, path string, value string")
    assert {r.tpl_id: (r.text, r.error) for r in tp.render_templates(t, c).collect()} == {k: (x, e) for k, (_, x, e) in enumerate(cases)}


def test_templates(spark):
    d = "$"
    t = spark.createDataFrame([(1, f"é {d}{{{{ A.b }}}}|{d}{d}{{{{ a.b }}}}|{d}{{{{nope}}}}|{d}x {d}{{{{ a.b }}}}")], "tpl_id bigint, template string")
    c = spark.createDataFrame([(7, 1, "a.B", "V"), (7, 1, "other", "z"), (8, 1, "other", "z")], "ctx_id bigint, tpl_id bigint, path string, value string")
    got = {r.ctx_id: r.text for r in tp.render_templates(t, c).collect()}
    assert got == {7: f"é V|{d}{d}{{{{ a.b }}}}||{d}x V", 8: f"é |{d}{d}{{{{ a.b }}}}||{d}x "}


def test_gate(spark):
    schema = "job_id bigint, step_idx bigint, ord bigint, kind string, key string, value string"
    writes = spark.createDataFrame([(1, 1, 0, "env", es.GATE_KEY, "true"), (1, 3, 0, "env", es.GATE_KEY, "no")], schema)
    steps = spark.createDataFrame([(j, s) for j in (1, 2) for s in range(5)], "job_id bigint, step_idx bigint")
    initial = spark.createDataFrame([(2, es.GATE_KEY, "T")], "job_id bigint, key string, value string")
    got = {(r.job_id, r.step_idx): r.allowed for r in es.unsecure_gate(steps, writes, initial).collect()}
    assert got == {**{(1, s): s in (2, 3) for s in range(5)}, **{(2, s): True for s in range(5)}}


def test_drop_blocked(spark):
    df = spark.createDataFrame([(1, "env", "A"), (1, "env", "NODE_OPTIONS"), (2, "output", "NODE_OPTIONS"), (3, "env", "B")], "f int, kind string, key string")
    kept, failed = es.drop_blocked(df, ["f", "kind"])
    assert sorted(r.f for r in kept.collect()) == [2, 3] and [r.f for r in failed.collect()] == [1]
    assert kept.filter(F.col("f") == 1).count() == 0
