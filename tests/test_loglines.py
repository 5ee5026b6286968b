"""Command parsing, echo, console and masking."""

import random

from pyspark.sql import functions as F

from cilake.operators import loglines as ll

CASES = [
    # line, command, data, properties
    ("::notice file=a.py,line=7,::look here", "notice", "look here", {"file": "a.py", "line": "7"}),
    ("\t::warning title=one,title=two::late\r\n", "warning", "late", {"title": "two"}),
    ("::endgroup::", "endgroup", "", {}),
    ("::error title=%3A%2Cx%0D%0A%25::up%0Adown%0D%25", "error", "up\ndown\r%", {"title": ":,x\r\n%"}),
    ("::notice a=1, b=2,odd,c=,::z", "notice", "z", {"a": "1", " b": "2"}),
    ("::set-output name=p::%2541", "set-output", "%41", {"name": "p"}),
    ("text before ::notice a=1::z", None, None, None),
    ("::unheard-of::z", None, None, None),
    ("::notice never closed", None, None, None),
    ("::q ##[error]z", None, None, None),
    ("##[error code=4;]bang", "error", "bang", {"code": "4"}),
    ("12:00 ##[error code=4;]bang", "error", "bang", {"code": "4"}),
    ("##[warning k=%5D%3B%0A;]%5Dx%3By%0D", "warning", "]x;y\r", {"k": "];\n"}),
    ("##[unheard] ##[error]z", None, None, None),
    ("##[warning", None, None, None),
    ("nothing at all", None, None, None),
]


def test_parse_commands(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "seq bigint, line string")
    parsed = ll.parse_commands(df)
    rows = {r.seq: r for r in parsed.collect()}
    props = {}
    for r in ll.command_props(parsed).collect():
        props.setdefault(r.seq, {})[r.key] = r.value
    for i, (line, command, data, want) in enumerate(CASES):
        assert (rows[i].command, rows[i].data) == (command, data), line
        assert rows[i].raw == (line if command else None)
        assert props.get(i, {}) == (want or {}), line


def log(spark, lines, job=1):
    return spark.createDataFrame([(job, 0, i, x) for i, x in enumerate(lines)], "job_id bigint, step_idx bigint, seq bigint, line string")


def test_console(spark):
    lines = ["before s3cret", "::echo::on", "::set-output name=a::b", "::add-mask::s3cret", "my secret is s3cret", "::group::T s3cret",
             "::warning::w", "::echo::off", "::endgroup::", "::debug::d"]
    want = ["before s3cret", "::set-output name=a::b", "my secret is ***", "::group::T ***", "##[group]T ***", "::echo::off", "##[endgroup]"]
    for block in (2, 65536):
        view = ll.console_view(log(spark, lines), block_rows=block).orderBy("seq", "sub")
        assert [r.text for r in view.collect()] == want
    shown = ll.console_view(log(spark, lines), debug=True).orderBy("seq", "sub").collect()
    assert shown[-1].text == "##[debug] ::debug::d"


def brute_mask(lines, masks):
    out = {}
    for job, seq, text in lines:
        hits = sorted((m for j, m, s in masks if j == job and s < seq and m in text), key=lambda m: (-len(m), m))
        for m in hits:
            text = text.replace(m, "***")
        out[(job, seq)] = text
    return out


def test_masking(spark):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("ab*") for _ in range(n))
    lines = [(1 if i % 3 else 2, i, word(rnd.randrange(0, 14))) for i in range(240)]
    masks = sorted({(rnd.choice([1, 1, 2]), word(rnd.randrange(1, 5))) for _ in range(40)})
    masks = [(j, m, rnd.randrange(-1, 200)) for j, m in masks]
    ldf = spark.createDataFrame(lines, "job_id bigint, seq bigint, line string")
    mdf = spark.createDataFrame(masks, "job_id bigint, mask string, mask_seq bigint")
    want = brute_mask(lines, masks)
    assert {(r.job_id, r.seq): r.line for r in ll.mask_lines(ldf, mdf).collect()} == want


def test_many_masks_of_many_lengths(spark):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    masks = [(1, word(3 + k % 50), -1) for k in range(10_000)]
    lines = [(1, i, " ".join([word(9), masks[rnd.randrange(10_000)][1], word(5)])) for i in range(300)]
    ldf = spark.createDataFrame(lines, "job_id bigint, seq bigint, line string")
    mdf = spark.createDataFrame(sorted(set(masks)), "job_id bigint, mask string, mask_seq bigint")
    got = {(r.job_id, r.seq): r.line for r in ll.mask_lines(ldf, mdf).collect()}
    assert got == brute_mask(lines, sorted(set(masks)))


def test_errors(spark):
    lines = ["::set-env::x", "::set-output name=::x", "::save-state::x", "::add-path::", "::echo::maybe", "::echo:: ON ", "::set-env name=a::x"]
    got = {r.seq: r.error for r in ll.command_errors(log(spark, lines)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    closed = ll.command_errors(log(spark, lines), allowed=F.lit(False))
    assert {r.seq for r in closed.collect()} == {0, 1, 2, 3, 4, 6}


def test_debug_lines(spark):
    df = log(spark, ["::debug::a\r\nb"])
    assert [r.text for r in ll.debug_lines(df).orderBy("sub").collect()] == ["##[debug] ::debug::a", "##[debug] b"]
    assert ll.debug_lines(df, enabled=False).count() == 0
