"""Build matrices: product of dimensions, excludes, includes, extra rows.

Dimensions are rows `(job_id, dim, pos, value)`; rules (excludes, includes) are rows
`(job_id, rule_pos, dim, value)`. Values compare as text, so canonical JSON keeps 1 and "1" apart.
A combination is numbered `combo` in mixed radix over the dimensions sorted by name.

Rules never meet combinations pairwise, and are matched in index space: a rule has a *key set* (stride and size of each
dimension it names) and a *signature*, the number that its values make in these digits. A combination's own number gives its
signature on a key set by arithmetic, so it meets rules by equality, without its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cilake.operators.binding import bind
from cilake.operators.running import BLOCK_ROWS, numbered
from cilake.session import written

SPAN = 65_536
JOB_ROWS = 1024  # of a job that is expanded inside its row
IN_ROW = 262_144  # steps that its expansion may take
TASK_ROWS = 262_144  # rows whose jobs one task expands; by their bytes tasks would be far too few


def _meet(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner") -> DataFrame:
    """Join by sorting both sides, which can spill; never by a broadcast.

    These tables grow with the jobs but compress well and unfold from few bytes, so by Spark's size checks a table of millions
    of rows looks small enough to be built as a hash table in the driver and in every task.
    """
    return left.join(right.hint("merge"), on, how)


def _radix(dims: DataFrame) -> DataFrame:
    """One row per job: dimensions by name with size and stride, and the number of combinations."""
    sizes = dims.groupBy("job_id", "dim").agg(F.count(F.lit(1)).alias("n"))
    lists = sizes.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("dim", "n"))).alias("d"))

    def product(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(1).cast("bigint"), lambda acc, x: acc * x["n"])

    strides = F.transform(
        "d", lambda x, i: F.struct(
            x["dim"].alias("dim"), x["n"].alias("n"),
            product(F.slice(F.col("d"), i + 2, F.size("d"))).alias("stride")))
    return lists.select("job_id", strides.alias("d"), product(F.col("d")).alias("total"))


def matrix_product(dims: DataFrame, empty_dims: DataFrame | None = None) -> DataFrame:
    """Cartesian product in long form: `(job_id, combo, dim, value)`.

    A job with an empty dimension (`empty_dims`: job_id) has no combination. The index range is
    unfolded in two steps of bounded length, so one huge matrix spreads over many tasks.
    """
    radix = _radix(dims)
    if empty_dims is not None:
        radix = _meet(radix, empty_dims.select("job_id").distinct(), "job_id", "left_anti")
    spans = _unfold(radix, F.expr(f"(total - 1) div {SPAN} + 1"), "span").repartition("job_id", "span")
    inside = F.least(F.lit(SPAN).cast("bigint"), F.col("total") - F.col("span") * SPAN)
    combos = _unfold(spans, inside, "_at").select("job_id", (F.col("span") * SPAN + F.col("_at")).alias("combo"))
    return values_of(combos, dims)


def _unfold(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, numbered from 0 in `name`, by sequences of at most SPAN entries (or n / SPAN)."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    many = rows.withColumn("_n", n.cast("bigint")).filter(F.col("_n") > 0).withColumn(
        "_span", F.explode(F.sequence(zero, F.expr(f"(_n - 1) div {SPAN}"))))
    first = F.col("_span") * SPAN
    return many.withColumn(name, F.explode(F.sequence(first, F.least(first + (SPAN - 1), F.col("_n") - one)))).drop("_n", "_span")


def values_of(numbers: DataFrame, dims: DataFrame) -> DataFrame:
    """Numbered combinations `(job_id, combo)` in long form."""
    digits = _meet(numbers, _radix(dims).select("job_id", "d"), "job_id").select("job_id", "combo", F.inline("d")).select(
        "job_id", "combo", "dim", F.expr("(combo div stride) % n").alias("pos"))
    return _meet(digits, dims.select("job_id", "dim", F.col("pos").cast("bigint").alias("pos"), "value"),
                 ["job_id", "dim", "pos"]).select("job_id", "combo", "dim", "value")


def _signed(rules: DataFrame, dims: DataFrame) -> DataFrame:
    """Per rule: key set and signature over the original dimensions it names (maybe none).

    A value that a dimension holds several times gives a row for each place, a value that it lacks a NULL signature. `known`:
    the rule names nothing but dimensions.
    """
    named = _meet(rules.groupBy("job_id", "rule_pos", "dim").agg(
        F.min("value").alias("value"), F.count_distinct("value").alias("_values")),
        _radix(dims).select("job_id", F.inline("d")), ["job_id", "dim"], "left")
    places = dims.groupBy(F.col("job_id").alias("_job"), F.col("dim").alias("_dim"), F.col("value").alias("_value")).agg(
        F.collect_list(F.col("pos").cast("bigint")).alias("_at"))
    placed = _meet(named, places, (F.col("job_id") == F.col("_job")) & (F.col("dim") == F.col("_dim"))
                        & F.col("value").eqNullSafe(F.col("_value")) & (F.col("_values") <= 1), "left")
    at = F.coalesce("_at", F.array().cast("array<bigint>"))
    parts = F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("stride", "n", at.alias("at")))))
    sums = "aggregate(_p, array(0L), (acc, p) -> flatten(transform(acc, a -> transform(p.at, x -> a + x * p.stride))))"
    return placed.groupBy("job_id", "rule_pos").agg(parts.alias("_p"), F.every(F.col("n").isNotNull()).alias("known")).select(
        "job_id", "rule_pos", "known", F.transform("_p", lambda x: F.struct(x["stride"], x["n"])).alias("keyset"),
        F.explode_outer(F.expr(sums)).alias("sig"))


def _signature(keyset: str) -> Column:
    """Signature of the combination `combo` on a key set; NULL without one."""
    return F.expr(f"aggregate({keyset}, 0L, (acc, k) -> acc + (combo div k.stride) % k.n * k.stride)")


def check_exclude_keys(dims: DataFrame, excludes: DataFrame) -> DataFrame:
    """Exclude keys that are no dimension of the job."""
    return _meet(excludes, dims.select("job_id", "dim").distinct(), ["job_id", "dim"], "left_anti").select(
        "job_id", "rule_pos", F.col("dim").alias("exclude_key"))


def matrix_exclude(combos: DataFrame, excludes: DataFrame, dims: DataFrame) -> DataFrame:
    """Drop every combination on which some exclude agrees; rules with an unknown key are ignored here."""
    dropped = rule_hits(combos, _signed(excludes, dims).filter("known")).select("job_id", "combo").distinct()
    return _meet(combos, dropped, ["job_id", "combo"], "left_anti")


def kept_numbers(dims: DataFrame, excludes: DataFrame, empty_dims: DataFrame | None = None) -> DataFrame:
    """`(job_id, combo)` of the product's combinations that no exclude agrees with, without the product.

    Dimensions unfold one after another, those that most rules name first. A rule is applied as soon as its last dimension has
    unfolded, to the numbers so far, so what it excludes never unfolds further: the cost follows what is left. Dimensions
    that no rule names unfold last, in spans dealt over the tasks. Rules with an unknown key are ignored.
    """
    radix = _radix(dims)
    if empty_dims is not None:
        radix = _meet(radix, empty_dims.select("job_id").distinct(), "job_id", "left_anti")
    uses = excludes.groupBy("job_id", "dim").agg((-F.count(F.lit(1))).alias("_uses"))
    ranked = _meet(radix.select("job_id", F.inline("d")), uses, ["job_id", "dim"], "left")
    by_use = ranked.groupBy("job_id").agg(F.array_sort(F.collect_list(
        F.struct(F.coalesce("_uses", F.lit(0)).alias("uses"), "dim", "stride", "n"))).alias("_o"))
    order = by_use.select("job_id", F.filter("_o", lambda x: x["uses"] < 0).alias("named"),
                          F.filter("_o", lambda x: x["uses"] == 0).alias("rest"))
    # level by stride and size: dimensions that agree in both have one value, whose digit is 0 at any level
    steps = F.transform("named", lambda x: F.struct(x["stride"], x["n"]))
    last = F.array_max(F.transform("keyset", lambda k: F.array_position(F.col("_steps"), k))).cast("int") - 1
    signed = _meet(_signed(excludes, dims).filter("known AND sig IS NOT NULL"), order.select("job_id", steps.alias("_steps")), "job_id")
    # a rule goes by the place of its key set among those of its level; places are few, as dimensions are
    place = F.dense_rank().over(Window.partitionBy("job_id", "last").orderBy("keyset"))
    placed = written(signed.select("job_id", last.alias("last"), "keyset", "sig").distinct().withColumn("place", place), "matrix-rules")
    places = dict(placed.groupBy("last").agg(F.max("place")).collect())
    sets = placed.groupBy("job_id").agg(F.map_from_entries(F.collect_set(
        F.struct(F.concat_ws(":", "last", "place").alias("at"), "keyset"))).alias("sets"))
    found = _meet(order, sets, "job_id", "left").withColumn("combo", F.lit(0).cast("bigint"))
    for level in range(1 + max(places, default=-1)):
        # a job without that dimension goes on as it is
        found = _unfold(found, F.expr(f"coalesce(try_element_at(named, {level + 1}).n, 1)"), "_digit").withColumn(
            "combo", F.col("combo") + F.col("_digit") * F.expr(f"coalesce(try_element_at(named, {level + 1}).stride, 0)"))
        for place in range(1, 1 + places.get(level, 0)):
            here = placed.filter((F.col("last") == level) & (F.col("place") == place)).select("job_id", F.col("sig").alias("_sig"))
            met = found.withColumn("_sig", _signature(f"try_element_at(sets, '{level}:{place}')"))
            found = _meet(met, here, ["job_id", "_sig"], "left_anti").drop("_sig")
    # named dimensions whose rules can never agree have not unfolded; they go with the rest
    done = 1 + max(places, default=-1)
    rest = F.concat(F.expr(f"slice(named, {done + 1}, size(named))"), F.col("rest"))
    open_ = found.select("job_id", "combo", rest.alias("rest")).withColumn("_many", F.expr("aggregate(rest, 1L, (acc, k) -> acc * k.n)"))
    spans = _unfold(open_, F.expr(f"(_many - 1) div {SPAN} + 1"), "_part").repartition("job_id", "combo", "_part")
    inside = F.least(F.lit(SPAN).cast("bigint"), F.col("_many") - F.col("_part") * SPAN)
    # mixed radix over what is left: the digits come off one by one
    digits = ("aggregate(rest, struct(_part * {0} + _at AS left, 0L AS sum), (acc, k) -> struct(acc.left div k.n AS left, "
              "acc.sum + acc.left % k.n * k.stride AS sum)).sum").format(SPAN)
    return _unfold(spans, inside, "_at").select("job_id", (F.col("combo") + F.expr(digits)).alias("combo"))


def rule_hits(combos: DataFrame, rules: DataFrame) -> DataFrame:
    """(job_id, combo, keyset, sig) of combinations (numbered or in long form) on which a rule (see `_signed`) agrees."""
    numbers = combos.select("job_id", "combo")
    numbers = numbers.distinct() if "dim" in combos.columns else numbers
    met = _meet(numbers, rules.select("job_id", "keyset").distinct(), "job_id").withColumn("sig", _signature("keyset"))
    return _meet(met, rules.select("job_id", "keyset", "sig").distinct(), ["job_id", "keyset", "sig"], "left_semi")


def matrix_include(combos: DataFrame, includes: DataFrame, dims: DataFrame, rules: DataFrame | None = None,
                   hits: DataFrame | None = None) -> DataFrame:
    """Combinations with the added keys of every include that agrees on the original dimensions.

    Later includes win per added key; includes are reduced per (key set, signature, key) first. `rules` and
    `hits` may be handed in where they are needed again.
    """
    rules = _signed(includes, dims) if rules is None else rules
    hits = rule_hits(combos, rules) if hits is None else hits
    others = _meet(includes, dims.select("job_id", "dim").distinct(), ["job_id", "dim"], "left_anti")
    added = _meet(others, rules, ["job_id", "rule_pos"]).groupBy("job_id", "keyset", "sig", "dim").agg(
        F.max_by("value", "rule_pos").alias("value"), F.max("rule_pos").alias("rule_pos"))
    merged = _meet(hits, added, ["job_id", "keyset", "sig"]).groupBy("job_id", "combo", "dim").agg(
        F.max_by("value", "rule_pos").alias("value"))
    return combos.select("job_id", "combo", "dim", "value").unionByName(merged)


def unmatched_includes(rules: DataFrame, hits: DataFrame) -> DataFrame:
    """Include rules that agree with no combination of their job."""
    matched = _meet(rules, hits.select("job_id", "keyset", "sig").distinct(), ["job_id", "keyset", "sig"], "left_semi")
    return _meet(rules.select("job_id", "rule_pos").distinct(), matched.select("job_id", "rule_pos"), ["job_id", "rule_pos"], "left_anti")


def matrix_extra(jobs: DataFrame, combos: DataFrame, includes: DataFrame, dims: DataFrame, rules: DataFrame | None = None,
                 hits: DataFrame | None = None) -> DataFrame:
    """Rows to append: unmatched includes as combinations of their own (numbered after the product),
    and one empty combination (dim NULL) for a job left with nothing."""
    totals = _meet(jobs.select("job_id").distinct(), _radix(dims).select("job_id", "total"), "job_id", "left").select("job_id", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    rules = _signed(includes, dims) if rules is None else rules
    hits = rule_hits(combos, rules) if hits is None else hits
    extra = _meet(_meet(includes, unmatched_includes(rules, hits), ["job_id", "rule_pos"], "left_semi"), totals, "job_id").select("job_id", (F.col("total") + F.col("rule_pos")).alias("combo"), "dim", "value")
    filled = combos.select("job_id").unionByName(extra.select("job_id")).distinct()
    none = F.lit(None).cast("string")
    empty = _meet(totals, filled, "job_id", "left_anti").select(
        "job_id", F.col("total").alias("combo"), none.alias("dim"), none.alias("value"))
    return extra.unionByName(empty)


def _rows(jobs: DataFrame, dims: DataFrame, excludes: DataFrame, includes: DataFrame, empty_dims: DataFrame | None) -> DataFrame:
    """The tables of matrices as one `(job_id, kind, pos, dim, value)`."""
    none = F.lit(None)

    def of(df: DataFrame, kind: str, pos: str | None = None) -> DataFrame:
        at, dim, value = (F.col(pos), F.col("dim"), F.col("value")) if pos else (none, none.cast("string"), none.cast("string"))
        return df.select("job_id", F.lit(kind).alias("kind"), at.cast("bigint").alias("pos"), dim.alias("dim"), value.alias("value"))

    rows = of(jobs, "job").unionByName(of(dims, "dim", "pos")).unionByName(of(excludes, "exclude", "rule_pos")).unionByName(
        of(includes, "include", "rule_pos"))
    return rows if empty_dims is None else rows.unionByName(of(empty_dims, "empty"))


def _packed(rows: DataFrame) -> DataFrame:
    """One row per job: dimensions and rules as arrays, and whether the job is `plain` and so can be expanded inside its row.

    Plain: positions 0 to n - 1 in each dimension, each key of a rule once, no NULL in either, and so few combinations and
    rules that the row stays small.
    """
    def pick(kind: str, *cols: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*cols))))

    packed = bind(rows.groupBy("job_id").agg(
        F.max(F.col("kind") == "job").alias("asked"), F.max(F.col("kind") == "empty").alias("empty"), pick("dim", "dim", "pos", "value").alias("cells"),
        pick("exclude", "pos", "dim", "value").alias("excludes"), pick("include", "pos", "dim", "value").alias("includes")),
        names=F.expr("array_distinct(transform(cells, x -> x.dim))"))
    packed = bind(packed, _d=F.expr("transform(names, name -> struct(name AS dim, filter(cells, x -> x.dim = name) AS cells))"))
    stride = "aggregate(slice(_d, i + 2, size(_d)), 1L, (acc, y) -> acc * size(y.cells))"
    packed = bind(
        packed, total=F.expr("IF(size(_d) > 0, aggregate(_d, 1L, (acc, y) -> acc * size(y.cells)), 0L)"),
        d=F.expr(f"transform(_d, (x, i) -> struct(size(x.cells) AS n, {stride} AS stride, transform(x.cells, y -> y.value) AS vals))"),
        _whole=F.expr("forall(_d, x -> forall(x.cells, y -> y.pos IS NOT NULL) AND "
                      "transform(x.cells, y -> y.pos) <=> sequence(0L, size(x.cells) - 1L))"),
        _clear=F.expr(" AND ".join(
            f"NOT exists({rules}, x -> x.pos IS NULL OR x.dim IS NULL) AND "
            f"size(array_distinct(transform({rules}, x -> struct(x.pos, x.dim)))) = size({rules})" for rules in ("excludes", "includes"))))
    work = f"total <= {SPAN} AND total * (1 + size(cells) + size(excludes) + size(includes) * size(includes)) <= {IN_ROW}"
    return packed.select("job_id", "asked", "empty", "names", "d", "total", "excludes", "includes", F.expr(
        f"job_id IS NOT NULL AND NOT exists(names, x -> x IS NULL) AND _whole AND _clear AND {work}").alias("plain"))


def _let(name: str, value: str, use: str) -> str:
    """SQL for `use` with `name` computed once; as a column it would be copied with its row at each step."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _expanded(plain: DataFrame) -> DataFrame:
    """The combinations of plain jobs (see `_packed`), each job inside its row; a job with an unknown exclude key has none."""
    fine = plain.filter("forall(excludes, x -> array_contains(names, x.dim))")

    def by_rule(rules: str, use: str) -> str:
        keys = (f"transform(filter({rules}, x -> x.pos = p AND array_contains(names, x.dim)), "
                "x -> struct(CAST(array_position(names, x.dim) - 1 AS INT) AS i, x.value AS value))")
        return f"transform(array_distinct(transform({rules}, x -> x.pos)), p -> {use.format(keys)})"

    def agrees(keys: str) -> str:
        return f"forall({keys}, k -> k.value <=> get(c.vals, k.i))"

    combos = ("IF(total > 0 AND NOT empty, transform(sequence(0L, total - 1), c -> struct(c AS combo, "
              "transform(d, x -> get(x.vals, CAST(c div x.stride % x.n AS INT))) AS vals)), array())")
    kept = f"filter({combos}, c -> NOT exists(_excludes, r -> {agrees('r')}))"
    original = "transform(names, (name, i) -> struct(c.combo AS combo, name AS dim, get(c.vals, i) AS value))"
    # later includes win per added key
    added = _let("_added", f"flatten(transform(filter(_includes, r -> {agrees('r.keys')}), r -> r.added))",
                 "transform(filter(_added, x -> NOT exists(_added, y -> y.dim = x.dim AND y.pos > x.pos)), "
                 "x -> struct(c.combo AS combo, x.dim AS dim, x.value AS value))")
    own = f"transform(filter(_includes, r -> NOT exists(_kept, c -> {agrees('r.keys')})), r -> r.pos)"
    extra = _let("_own", own, (
        "IF(size(_kept) + size(_own) = 0, array(struct(total AS combo, CAST(NULL AS STRING) AS dim, CAST(NULL AS STRING) AS value)), "
        "transform(filter(includes, x -> array_contains(_own, x.pos)), x -> struct(total + x.pos AS combo, x.dim AS dim, x.value AS value)))"))
    found = f"concat(flatten(transform(_kept, c -> concat({original}, {added}))), IF(asked, {extra}, array()))"
    included = by_rule("includes", "struct(p AS pos, {} AS keys, filter(includes, x -> x.pos = p AND NOT array_contains(names, x.dim)) AS added)")
    every = _let("_excludes", by_rule("excludes", "{}"), _let("_kept", kept, _let("_includes", included, found)))
    return fine.select("job_id", F.inline(F.expr(every)))


def expand_matrix(jobs: DataFrame, dims: DataFrame, excludes: DataFrame, includes: DataFrame,
                  empty_dims: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(combinations in long form, jobs in error). A job with an unknown exclude key has no combinations.

    Tables are written once and their rows shuffled once by job. Jobs whose rows and combinations are few expand inside their row;
    the others, and those with repeated or NULL keys, by the joins of `_spread_out`.
    """
    rows = written(_rows(jobs, dims, excludes, includes, empty_dims), "matrix-rows")
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))

    def tables(rows: DataFrame) -> list[DataFrame]:
        def of(kind: str, *cols: Column | str) -> DataFrame:
            return rows.filter(F.col("kind") == kind).select("job_id", *cols)

        rule = [F.col("pos").alias("rule_pos"), "dim", "value"]
        return [of("job"), of("dim", "dim", "pos", "value"), of("exclude", *rule), of("include", *rule), of("empty")]

    _, dims, excludes, _, _ = tables(rows)
    errors = check_exclude_keys(dims, excludes)
    # no row may hold a job of any size
    large = written(rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > JOB_ROWS).select("job_id"), "matrix-large")
    same = lambda others: F.col("job_id").eqNullSafe(others["_job"])
    named = large.withColumnRenamed("job_id", "_job")
    small = rows if large.isEmpty() else _meet(rows, named, same(named), "left_anti")
    packed = written(_packed(small.repartition(tasks, "job_id")), "matrix-jobs")
    whole = _expanded(packed.filter("plain").repartition(tasks, "job_id"))
    others = large.unionByName(packed.filter("NOT plain").select("job_id"))
    if others.isEmpty():
        return whole, errors
    named = others.withColumnRenamed("job_id", "_job")
    return whole.unionByName(_spread_out(*tables(written(_meet(rows, named, same(named), "left_semi"), "matrix-others")))), errors


def _spread_out(jobs: DataFrame, dims: DataFrame, excludes: DataFrame, includes: DataFrame, empty_dims: DataFrame) -> DataFrame:
    """Combinations in long form, by joins, so that one huge matrix spreads over many tasks.

    The numbers of the kept combinations are written once, as they feed many joins; values are looked up for these alone.
    """
    bad = check_exclude_keys(dims, excludes).select("job_id").distinct()
    fine = lambda df: _meet(df, bad, "job_id", "left_anti")
    jobs, dims, includes = fine(jobs), fine(dims), fine(includes)
    kept = written(kept_numbers(dims, fine(excludes), empty_dims), "matrix-kept")
    rules = written(_signed(includes, dims), "matrix-rules")
    hits = written(rule_hits(kept, rules), "matrix-hits")
    return matrix_include(values_of(kept, dims), includes, dims, rules, hits).unionByName(
        matrix_extra(jobs, kept, includes, dims, rules, hits))


def matrix_index(combos: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of each combination in its job."""
    return numbered(combos.select("job_id", "combo").distinct(), ["job_id"], "combo", "job_index",
                    block_rows=block_rows)


def strategy_totals(combos: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Index and total of each combination's job."""
    totals = combos.select("job_id", "combo").distinct().groupBy("job_id").agg(F.count(F.lit(1)).alias("job_total"))
    return _meet(matrix_index(combos, block_rows), totals, "job_id")
