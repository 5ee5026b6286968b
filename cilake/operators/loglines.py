"""Commands inside log lines: extraction, routing, echo state, groups, masking, console view.

Log lines are rows `(job_id, step_idx, seq, line)`; `seq` orders the lines of a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.functions import text as tx
from cilake.operators.binding import bind
from cilake.operators.grams import distinct_grams, lead_gram
from cilake.operators.running import BLOCK_ROWS, Run, running
from cilake.session import written

# The known command names.
COMMANDS = [
    "set-env", "set-output", "save-state", "add-mask", "add-path", "add-matcher", "remove-matcher",
    "debug", "warning", "error", "notice", "group", "endgroup", "echo",
]
# What a line does, by command name.
EFFECTS = {
    "set-env": "env", "set-output": "output", "save-state": "state", "add-mask": "mask", "add-path": "path",
    "add-matcher": "matcher", "remove-matcher": "matcher", "debug": "debug", "warning": "annotation",
    "error": "annotation", "notice": "annotation", "group": "group", "endgroup": "endgroup", "echo": "echo",
}
_V2 = r"(?s)^::(.*?)::(.*)$"
_V1 = r"(?s)^##\[([^\]]*)\](.*)$"


def _name(header: Column) -> Column:
    return F.substring_index(header, " ", 1)


def _prop_text(header: Column) -> Column:
    """Everything after the first blank of the header, left-trimmed."""
    return F.when(F.instr(header, " ") > 0, F.ltrim(F.regexp_replace(header, r"(?s)^[^ ]* ", ""))).otherwise("")


def parse_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add command, header properties (text), unescaped data, form and raw; plain text has NULLs.

    `prop_text` and `form` feed `command_props`, which returns the properties as rows or a map.
    """
    t, header = F.col("_t"), F.col("_header")
    trimmed = bind(lines, _t=tx.trim_space(F.col(line)))
    tail = F.substring(t, F.instr(t, "##["), F.length(t))
    split = bind(
        trimmed,
        _form=F.when(t.startswith("::"), F.when(t.rlike(_V2), "v2")).when(
            F.instr(t, "##[") > 0, F.when(tail.rlike(_V1), "v1")),
        _header=F.when(t.startswith("::"), F.regexp_extract(t, _V2, 1)).otherwise(F.regexp_extract(tail, _V1, 1)),
        _data=F.when(t.startswith("::"), tx.unescape_data(F.regexp_extract(t, _V2, 2))).otherwise(
            tx.unescape_legacy(F.regexp_extract(tail, _V1, 2))),
    )
    named = bind(split, form=F.when(_name(header).isin(COMMANDS), F.col("_form")))
    known = F.col("form").isNotNull()
    done = bind(
        named,
        command=F.when(known, _name(header)),
        prop_text=F.when(known, _prop_text(header)),
        data=F.when(known, F.col("_data")),
        raw=F.when(known, F.col(line)),
    )
    return done.select(*lines.columns, "form", "command", "prop_text", "data", "raw")


def prop_entries(prop_text: Column, form: Column) -> Column:
    """Array of (key, value, pos): split on `,` (v2) or `;` (v1); entries without `=` or value are dropped."""

    def entry(p: Column, i: Column) -> Column:
        value = F.substring(p, F.instr(p, "=") + 1, F.length(p))
        value = F.when(form == "v2", tx.unescape_prop(value)).otherwise(tx.unescape_legacy(value))
        return F.struct(F.substring_index(p, "=", 1).alias("key"), value.alias("value"), i.alias("pos"))

    parts = F.when(form == "v2", F.split(prop_text, ",")).otherwise(F.split(prop_text, ";"))
    return F.filter(
        F.transform(parts, lambda p, i: F.when((F.instr(p, "=") > 0) & ~p.rlike(r"(?s)^[^=]*=$"), entry(p, i))),
        lambda e: e.isNotNull(),
    )


def prop_value(key: str, prop_text: Column, form: Column) -> Column:
    """The last value of one property, or NULL."""
    hits = F.filter(prop_entries(prop_text, form), lambda e: e["key"] == key)
    return F.when(F.size(hits) > 0, F.element_at(hits, -1)["value"])


def prop_map(prop_text: Column, form: Column) -> Column:
    """Properties as a map; the last duplicate wins."""
    entries = prop_entries(prop_text, form)
    last = F.filter(entries, lambda e: ~F.exists(entries, lambda o: (o["key"] == e["key"]) & (o["pos"] > e["pos"])))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def command_props(parsed: DataFrame) -> DataFrame:
    """One row per property (key, value); the last duplicate of a line wins. Narrow: no shuffle."""
    keep = [c for c in parsed.columns if c not in ("prop_text", "form")]
    return parsed.filter(F.col("form").isNotNull()).select(
        *keep, F.explode(prop_map(F.col("prop_text"), F.col("form"))).alias("key", "value")
    )


def known_commands(names: Column) -> Column:
    return names.isin(COMMANDS)


def classify_lines(parsed: DataFrame) -> DataFrame:
    """Add `effect`: what the line does; lines that are no command are 'text'."""
    table = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])
    return bind(parsed, effect=F.coalesce(F.try_element_at(table, F.col("command")), F.lit("text")))


def with_name(parsed: DataFrame) -> DataFrame:
    """Add the `name` property as a column ('' when absent)."""
    return bind(parsed, name=F.coalesce(prop_value("name", F.col("prop_text"), F.col("form")), F.lit("")))


def error_of(allowed: Column | None = None) -> Column:
    """Error of a classified line with its `name`, or NULL."""
    gate = F.lit(True) if allowed is None else allowed
    no_name = F.col("name") == ""
    return (
        F.when((F.col("effect") == "env") & ~gate, "set-env is disabled")
        .when((F.col("effect") == "env") & no_name, "environment variable name cannot be empty")
        .when((F.col("effect") == "output") & no_name, "output variable name cannot be empty")
        .when((F.col("effect") == "state") & no_name, "state key name cannot be empty")
        .when((F.col("effect") == "path") & (F.col("data") == ""), "path cannot be empty")
        .when((F.col("effect") == "echo") & ~F.upper(tx.trim_space(F.col("data"))).isin("ON", "OFF"),
              "echo command accepts only 'on' or 'off'")
    )


def command_errors(lines: DataFrame, allowed: Column | None = None) -> DataFrame:
    """Rows of commands that fail, with the reason. Filters the command names before the rest.

    `allowed` tells whether set-env may run; by default the `allowed` column of the lines, if they have one.
    """
    if allowed is None and "allowed" in lines.columns:
        allowed = F.col("allowed")
    parsed = classify_lines(parse_commands(lines)).filter(
        F.col("effect").isin("env", "output", "state", "path", "echo")
    )
    return bind(with_name(parsed), error=error_of(allowed)).filter(F.col("error").isNotNull())


def debug_lines(lines: DataFrame, enabled: bool = True) -> DataFrame:
    """Debug commands as console lines, one per line of the raw text; none when not enabled."""
    parsed = parse_commands(lines).filter((F.col("command") == "debug") & F.lit(enabled))
    pieces = F.split(F.replace(F.col("raw"), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return parsed.select(*lines.columns, F.posexplode(pieces).alias("sub", "_piece")).select(
        *lines.columns, "sub", F.concat(F.lit("##[debug] "), "_piece").alias("text")
    )


def annotations(lines: DataFrame) -> DataFrame:
    """notice/warning/error commands with message and place."""
    parsed = parse_commands(lines).filter(F.col("command").isin("notice", "warning", "error"))
    prop = lambda k: prop_value(k, F.col("prop_text"), F.col("form"))
    return parsed.select(*lines.columns, F.col("command").alias("level"), F.col("data").alias("message"),
                         prop("file").alias("file"), prop("line").alias("file_line"), prop("code").alias("code"))


def annotation_counts(lines: DataFrame) -> DataFrame:
    """Annotations by job and level; counted before the shuffle."""
    parsed = parse_commands(lines).filter(F.col("command").isin("notice", "warning", "error"))
    return parsed.groupBy("job_id", F.col("command").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def echo_flag() -> Column:
    """1/0 at a valid echo command, NULL elsewhere."""
    word = F.upper(tx.trim_space(F.col("data")))
    return F.when((F.col("command") == "echo") & (word == "ON"), 1).when(
        (F.col("command") == "echo") & (word == "OFF"), 0
    )


def echo_flags(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `flag`: the last echo command before this line in its step (1, 0, or NULL for none)."""
    parsed = bind(parse_commands(lines), _flag=echo_flag())
    return running(parsed, ["job_id", "step_idx"], "seq", [Run("flag", "last", F.col("_flag"))],
                   inclusive=False, block_rows=block_rows).drop("_flag")


def echo_state(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add `echo`: is echoing on *before* this line, per step; starts off."""
    return echo_flags(lines, block_rows).withColumn("echo", F.coalesce(F.col("flag"), F.lit(0)) == 1).drop("flag")


def log_groups(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the number and title of the group block each line is in (0 and NULL before the first)."""
    parsed = parse_commands(lines)
    is_group = F.when(F.col("command") == "group", 1).otherwise(0).cast("bigint")
    return running(parsed, ["job_id"], "seq",
                   [Run("block_no", "sum", is_group),
                    Run("title", "last", F.when(F.col("command") == "group", F.col("data")))],
                   inclusive=True, block_rows=block_rows)


def log_group_sizes(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return log_groups(lines, block_rows).groupBy("job_id", "block_no").agg(
        F.max("title").alias("title"), F.count(F.lit(1)).alias("n_lines")
    )


def masks_of(parsed: DataFrame) -> DataFrame:
    """First registration of each mask text per job (empty masks hide nothing)."""
    return (
        parsed.filter((F.col("command") == "add-mask") & (F.col("data") != ""))
        .groupBy("job_id", F.col("data").alias("mask"))
        .agg(F.min("seq").alias("mask_seq"))
    )


def _hide(text: Column, masks: Column) -> Column:
    """Replace each mask in turn: the longest first, equal lengths by text."""
    ordered = F.array_sort(F.transform(masks, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m"))))
    return F.aggregate(ordered, text, lambda acc, m: F.replace(acc, m["m"], F.lit("***")))


GRAM = 4  # letters of a mask that lead to its lines; shorter masks are looked up whole


MAX_WORDS = 1024  # of a job's bit set of mask grams; a fuller set lets more grams pass, none is lost


def _bit_sets(led: DataFrame) -> DataFrame:
    """(job_id, _lengths, _since, _bits): gram lengths, first mask, and a bit set of the leading grams, about 16 bits a mask."""
    sizes = led.groupBy("job_id").agg(
        F.collect_set("_n").alias("_lengths"), F.min("mask_seq").alias("_since"),
        F.least(F.lit(MAX_WORDS), F.greatest(F.lit(16), F.ceil(F.count("*") / 4))).cast("int").alias("_words"))
    placed = led.join(sizes, "job_id").select("job_id", "_lengths", "_since", "_words", *_bit_of(F.col("_gram")))
    words = placed.groupBy("job_id", "_lengths", "_since", "_words", "_word").agg(F.bit_or("_bit").alias("_bit"))
    return words.groupBy("job_id", "_lengths", "_since", "_words").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bit"))).alias("_map")).select(
        "job_id", "_lengths", "_since", "_words", F.transform(F.sequence(F.lit(0), F.col("_words") - 1), lambda w: F.coalesce(
            F.try_element_at("_map", w), F.lit(0).cast("bigint"))).alias("_bits"))


def _bit_of(gram: Column) -> tuple[Column, Column]:
    """Word number and bit of a gram in a set of `_words` words."""
    h = F.xxhash64(gram)
    return F.pmod(F.shiftright(h, 6), F.col("_words")).cast("int").alias("_word"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.pmod(h, F.lit(64)).cast("int")).alias("_bit")


def mask_lines(lines: DataFrame, masks: DataFrame, text: str = "line", *, keys: list[str] | None = None) -> DataFrame:
    """Hide in `text` every mask registered earlier in the same job, as `***`.

    A line hides the masks that occur in it, the longest first. Each mask is led to its lines by one gram of its own
    (the one with the smallest hash), met by equality with the grams of the lines of jobs that have masks; what
    meets is then checked. So work grows with the text and the hits, not with lines times masks.
    Before a line unfolds into grams these are probed in the bit set of its job, so only grams that may lead to a mask, of lines
    after the job's first mask, are shuffled. `keys` identify a line (default job_id, seq).
    """
    keys = keys or ["job_id", "seq"]
    n = F.least(F.length("mask"), F.lit(GRAM))
    led = masks.select("job_id", "mask", "mask_seq", n.alias("_n"), lead_gram(F.col("mask"), n).alias("_gram"))
    near = lines.join(_bit_sets(led), "job_id").filter(F.col("seq") > F.col("_since"))
    every = F.array_distinct(F.flatten(F.transform("_lengths", lambda k: distinct_grams(F.col(text), k))))

    def may_lead(gram: Column) -> Column:
        word, bit = _bit_of(gram)
        return F.get("_bits", word).bitwiseAND(bit) != 0

    grams = near.select(*keys, F.explode(F.filter(every, may_lead)).alias("_gram"))
    met = grams.join(led, ["job_id", "_gram"]).filter(F.col("mask_seq") < F.col("seq"))
    found = met.groupBy(*keys).agg(F.collect_set("mask").alias("_found"))
    hidden = _hide(F.col(text), F.filter("_found", lambda m: F.contains(F.col(text), m)))
    return lines.join(found, keys, "left").select(
        *[F.coalesce(hidden, F.col(text)).alias(text) if c == text else F.col(c) for c in lines.columns])


def console_rows(parsed: DataFrame, debug: bool = False) -> DataFrame:
    """Printed rows before masking: an echoed raw command first (sub 0), then the line's own text (sub 1..)."""
    p = classify_lines(parsed)
    echoed = F.col("echo") & F.col("effect").isin("env", "output", "state", "path", "group", "endgroup", "echo")
    if "allowed" in parsed.columns:  # a refused set-env is not echoed
        echoed = echoed & ((F.col("effect") != "env") | F.col("allowed"))
    raw = F.coalesce(F.col("raw"), F.col("line"))
    pieces = F.split(F.replace(raw, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    own = (
        F.when(F.col("effect") == "text", F.array(F.col("line")))
        .when(F.col("effect").isin("group", "endgroup"),
              F.array(F.concat(F.lit("##["), F.col("effect"), F.lit("]"), F.col("data"))))
        .when((F.col("effect") == "debug") & F.lit(debug),
              F.transform(pieces, lambda x: F.concat(F.lit("##[debug] "), x)))
        .otherwise(F.array().cast("array<string>"))
    )
    printed = F.concat(F.array(F.when(echoed, raw)), own)
    return p.select("job_id", "step_idx", "seq", F.posexplode(printed).alias("sub", "text")).filter(
        F.col("text").isNotNull()
    )


def console_view(lines: DataFrame, *, debug: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What a reader sees: `(job_id, step_idx, seq, sub, text)`, masked; order by (job, seq, sub).

    Lines are read and parsed once; masks and printed rows come from the written result. Lines with an
    `allowed` column (see `writes.with_gate`) leave out what a closed gate refuses.
    """
    seen = written(echo_state(lines, block_rows), "echoed")
    masks = written(masks_of(seen), "masks")
    return mask_lines(console_rows(seen, debug), masks, "text", keys=["job_id", "seq", "sub"])
