"""Language identification by fusing Bayesian evidence.

For a page and each language, the log posterior adds up
  * the text: log likelihoods of the visible text's character trigrams, weighted by `TEXT_WEIGHT` since
    neighbouring trigrams are no independent evidence;
  * the declared markup language (`<html lang>`): P(declared | language);
  * the address suffix (last host label): P(suffix | language);
  * the host's prior, smoothed hierarchically: all pages -> registered domain -> host, each level drawn
    towards the one above by `PRIOR_PAGES` imagined pages.
All these tables are grouped aggregates over all pages, of pages by the language their text alone suggests; a
page's own vote is taken out before it is judged. A hot host costs one row per task before the shuffle; its
pages look the counts up in a join that Spark splits where it is skewed.

The text model is fitted on a bounded sample: per language the `SAMPLE_DOCS` different texts with the smallest hashes. Ids play no
part, so a text trains its own language only, whatever ids repeat.

Defined cases: a null or empty page, or one without visible text, has no text evidence and is judged by the rest; a null
url has host, domain and suffix ''; an undeclared language is the value ''. Ties go to the language first in
alphabetical order. Rows with a null language or text do not train; without any language the result is null. Repeated
pages are judged alike. Long pages take linear time, also where tags, comments or scripts never close. Existing columns named like a result column are replaced by it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cilake.session import written

SAMPLE_DOCS = 1000
BUCKET_BITS = 16
TEXT_WEIGHT = 0.1
PRIOR_PAGES = 5.0
SMOOTH = 0.5

_OPENS = re.compile(r"(?i)<(?:(script|style|nav|noscript)\b|!--)")
_CLOSES = {k: re.compile(rf"(?i)</{k}\s*>") for k in ("script", "style", "nav", "noscript")} | {"": re.compile("-->")}
#: No `<` inside, so that a row of unclosed tags is read once.
_DECLARED = r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([a-z]{2,8})"
_CHUNK = 1 << 16


def shown(page: str) -> Iterator[str]:
    """What lies between scripts, styles, navigation and comments. An opener whose closer never comes hides nothing.

    Every kind of closer is searched from left to right over the page once, so time is linear.
    """
    at, seek, absent = 0, 0, set()
    while m := _OPENS.search(page, seek):
        kind = (m[1] or "").lower()
        end = None if kind in absent else _CLOSES[kind].search(page, m.end())
        if end:
            yield page[at : m.start()]
            at = seek = end.end()
        else:
            absent.add(kind)
            seek = m.end()
    yield page[at:]


def untagged(text: str) -> Iterator[str]:
    """What lies outside tags; a `<` without any `>` behind it is no tag."""
    at = 0
    while (start := text.find("<", at)) >= 0 and (end := text.find(">", start)) >= 0:
        yield text[at:start]
        at = end + 1
    yield text[at:]


def visible_text(page: str) -> str:
    return " ".join(entities.unescape(" ".join(untagged(" ".join(shown(page))))).split())


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of the character trigrams of the lower-case text, framed by spaces, in chunks."""
    framed = f" {text.lower()} "
    for k in range(0, len(framed) - 2, _CHUNK):
        c = np.frombuffer(framed[k : k + _CHUNK + 2].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        mixed = (c[:-2] * np.uint64(1 << 42) + c[1:-1] * np.uint64(1 << 21) + c[2:]) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


class TextModel:
    """Log likelihoods per bucket and language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTH
        self.table = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if len(languages) else counts

    def score(self, text: str) -> list[float]:
        if not text:
            return [0.0] * len(self.languages)
        return sum(self.table[:, part].sum(axis=1) for part in trigrams(text)).tolist()


def sample(docs: DataFrame, lang: str, text: str, rows: int) -> DataFrame:
    """(lang, text): of each language the `rows` different texts with the smallest hashes, or all if there are fewer.

    Texts whose hash lies below a bound, set from the approximate number of different ones so that some more than `rows`
    pass, are all that is shuffled; the exact cut is made among these few.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(lang, text).alias("_h"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("_h").alias("_n"))
    bound = F.col("_h") / F.lit(2.0**64) + 0.5 < F.lit(1.5 * rows + 20) / F.col("_n")
    some = known.join(written(sizes, "languages"), "lang").filter(bound)
    some = written(some.groupBy("lang", "_h").agg(F.first("text").alias("text")), "sample")
    order = Window.partitionBy("lang").orderBy("_h")
    return some.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rows).select("lang", "text")


def fit_text(docs: DataFrame, lang: str = "lang", text: str = "text", rows: int = SAMPLE_DOCS) -> TextModel:
    """Fit on at most `rows` different texts a language; only bucket counts reach the driver."""
    picked = sample(docs, lang, text, rows)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang_, text_ in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen = sum(np.bincount(part, minlength=1 << BUCKET_BITS) for part in trigrams(text_.as_py()))
                total[lang_] = total[lang_] + seen if lang_ in total else seen
        for lang_, seen in total.items():
            at = np.nonzero(seen)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang_] * len(at)), pa.array(at), pa.array(seen[at])], names=["lang", "bucket", "n"])

    got = picked.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[np.searchsorted(languages, got["lang"].to_numpy()).astype(int) if len(languages) else [],
           got["bucket"].to_numpy()] = got["n"].to_numpy()
    return TextModel(languages, counts)


def address(url: Column) -> tuple[Column, Column, Column]:
    """(host, registered domain taken as the last two labels, suffix)."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*?://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    return host, F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."), F.element_at(labels, -1)


def evidence(pages: DataFrame, model: TextModel, page_id: str, url: str, html: str) -> DataFrame:
    """One narrow row a page: page_id, text_score array, guess (position of the best score, null without text), host, domain, suffix, declared."""

    @F.arrow_udf("array<double>")
    def text_score(markup: pa.Array) -> pa.Array:
        return pa.array([model.score(visible_text(x.as_py() or "")) for x in markup], pa.list_(pa.float64()))

    host, domain, suffix = address(F.col(url))
    declared = F.lower(F.coalesce(F.regexp_extract(F.col(html), _DECLARED, 1), F.lit("")))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), domain.alias("domain"), suffix.alias("suffix"),
                        declared.alias("declared"), text_score(F.col(html)).alias("text_score"))
    best = F.array_position("text_score", F.array_max("text_score")).cast("int") - 1
    return rows.withColumn("guess", F.when(F.array_max("text_score") < 0, best))


def votes(n: int) -> list[Column]:
    return [F.sum((F.coalesce(F.col("guess"), F.lit(-1)) == k).cast("bigint")).alias(f"n{k}") for k in range(n)]


def identify(pages: DataFrame, model: TextModel, page_id: str = "page_id", url: str = "url", html: str = "html",
             text_weight: float = TEXT_WEIGHT, prior_pages: float = PRIOR_PAGES) -> DataFrame:
    """page_id, language, probability, text_language, declared, suffix, host for every row of `pages`."""
    n = len(model.languages)
    seen = written(evidence(pages, model, page_id, url, html), "evidence")
    if not n:
        none = F.lit(None).cast("string")
        return seen.select("page_id", none.alias("language"), F.lit(None).cast("double").alias("probability"),
                           none.alias("text_language"), "declared", "suffix", "host")
    languages = F.array(*[F.lit(x) for x in model.languages])
    hosts = written(seen.groupBy("host", "domain").agg(*votes(n)), "hosts")
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(n)])
    tables = {"h": ("host", hosts.drop("domain")), "m": ("domain", domains),
              "d": ("declared", seen.groupBy("declared").agg(*votes(n))), "s": ("suffix", seen.groupBy("suffix").agg(*votes(n)))}
    every = hosts.agg(*[F.sum(f"n{k}") for k in range(n)]).first()
    every = [float(x or 0) for x in every]
    kinds = {t: tables[t][1].count() for t in "ds"}
    joined = seen
    for t, (key, counts) in tables.items():
        joined = joined.join(counts.withColumnsRenamed({f"n{k}": f"{t}{k}" for k in range(n)}), key)

    own = [(F.coalesce(F.col("guess"), F.lit(-1)) == k).cast("double") for k in range(n)]
    mine = F.when(F.col("guess").isNull(), 0.0).otherwise(1.0)

    def others(t: str, k: int) -> Column:
        return F.col(f"{t}{k}") - own[k]

    total = sum(every)
    prior = [(F.lit(every[k]) - own[k] + SMOOTH) / (F.lit(total) - mine + SMOOTH * n) for k in range(n)]
    for t in "mh":
        size = reduce(lambda a, b: a + b, [F.col(f"{t}{k}") for k in range(n)]) - mine
        prior = [(others(t, k) + F.lit(prior_pages) * prior[k]) / (size + F.lit(prior_pages)) for k in range(n)]
    logs = []
    for k in range(n):
        fit = [(others(t, k) + SMOOTH) / (F.lit(every[k]) - own[k] + SMOOTH * max(1, kinds[t])) for t in "ds"]
        logs.append(F.log(prior[k]) + F.log(fit[0]) + F.log(fit[1]) + F.lit(text_weight) * F.col("text_score")[k])
    judged = joined.withColumn("_log", F.array(*logs)).withColumn("_top", F.array_max("_log"))
    share = F.aggregate("_log", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("_top")))
    return judged.select(
        "page_id", F.element_at(languages, F.array_position("_log", F.col("_top")).cast("int")).alias("language"),
        (F.lit(1.0) / share).alias("probability"), F.when(F.col("guess") >= 0, languages[F.col("guess")]).alias("text_language"),
        "declared", "suffix", "host")
