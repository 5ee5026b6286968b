"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is cut into units, each a word with the white space before it; white space after the last word is one more
unit. Two cut points, drawn from the SHA-256 of the seed and the doc_id, part the units into prefix, middle and suffix. The
text stays as it is (plain) or is written with the middle last: prefix, suffix, middle (psm) or suffix, prefix, middle (spm),
each piece after its marker. `restore` rebuilds the text from output and form alone.

Inside a task everything is columns: texts are split into list arrays, lists are flattened with the index of their
parent, each unit gets its ordinal in its parent, a piece is the filter of the units by role, lists are rebuilt and
joined. Batches are worked off in slabs of about 4 MB, so memory holds a few copies of one slab, or of one larger text.
The work is narrow: no shuffle, no state, so a lost task is just run again.

Defined cases: a null text counts as empty; an empty text, or one that contains a marker, is plain (so markers in an output are
always those set here). A null doc_id draws as the text `null`. Repeated rows give equal results. White space is
0x20 and 0x09 to 0x0D; other Unicode spaces belong to words. An empty table gives an empty result. Existing columns named like
a result column are replaced by it. `restore` gives null for an output that does not fit its form.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cilake.llm.common import fresh, slabs

SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
_MARKER = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
_FIELDS = [("n", "bigint", pa.int64()), ("form", "string", pa.string()), ("prefix_chars", "bigint", pa.int64()),
           ("middle_chars", "bigint", pa.int64()), ("output", "string", pa.string())]


def draws(doc_id: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)]


def ordinals(parent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Position of each flattened item in its parent's list; `parent` ascends."""
    return np.arange(len(parent)) - (np.cumsum(counts) - counts)[parent]


def flattened(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all texts one after another, and the index of the text of each.

    Of a text with k words the gaps around them are k + 1 strings: one before each word, one after the last.
    """
    word, parent = flattened(pc.split_pattern_regex(texts, _SPACE))
    full = pc.greater(pc.binary_length(word), 0)
    word, parent = word.filter(full), parent[full.to_numpy(zero_copy_only=False)]
    gap, owner = flattened(pc.split_pattern_regex(texts, _WORD))
    n_words, n_gaps = (np.bincount(x, minlength=len(texts)) for x in (parent, owner))
    leads = ordinals(owner, n_gaps) < n_words[owner]
    last = ~leads & pc.greater(pc.binary_length(gap), 0).to_numpy(zero_copy_only=False)
    led = pc.binary_join_element_wise(gap.filter(pa.array(leads)), word, "")
    parents = np.concatenate([parent, owner[last]])
    order = np.argsort(parents, kind="stable")
    return pa.concat_arrays([led, gap.filter(pa.array(last))]).take(pa.array(order)), parents[order]


def joined(items: pa.Array, parent: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """For each of `rows` parents the kept items joined to one string."""
    ends = np.cumsum(np.bincount(parent[keep], minlength=rows))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), items.filter(pa.array(keep)))
    return pc.binary_join(lists, "")


def infilled(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The result columns of some texts without nulls."""
    rows = len(texts)
    unit, parent = units(texts)
    n = np.bincount(parent, minlength=rows)
    at = ordinals(parent, n)
    cut = np.stack([h[0] % (n + 1), h[1] % (n + 1)])
    role = (at >= cut.min(axis=0)[parent]).astype(np.int8) + (at >= cut.max(axis=0)[parent])
    prefix, middle, suffix = (joined(unit, parent, role == r, rows) for r in range(3))
    marked = pc.match_substring_regex(texts, _MARKER).to_numpy(zero_copy_only=False)
    plain = pa.array((pc.binary_length(texts).to_numpy() == 0) | marked | (h[2] % 100 >= fim_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    pieces = [pc.if_else(spm, SUFFIX, PREFIX), pc.if_else(spm, suffix, prefix),
              pc.if_else(spm, PREFIX, SUFFIX), pc.if_else(spm, prefix, suffix), MIDDLE, middle]
    chars = [pc.if_else(plain, None, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    return [pa.array(n, pa.int64()), form, *chars, pc.if_else(plain, texts, pc.binary_join_element_wise(*pieces, ""))]


def rebuilt(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and forms; null where an output does not hold the pieces of its form."""
    pieces = pc.split_pattern_regex(output, _MARKER)
    framed = pc.fill_null(pc.is_in(form, pa.array(["psm", "spm"], form.type)), False)
    whole = pc.fill_null(pc.and_(framed, pc.equal(pc.list_value_length(pieces), 4)), False)
    parts = pieces.filter(whole)
    a, b, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    spm = pc.equal(form.filter(whole), "spm")
    text = pc.binary_join_element_wise(pc.if_else(spm, b, a), middle, pc.if_else(spm, a, b), "")
    plain = pc.if_else(pc.fill_null(pc.equal(form, "plain"), False), output, pa.scalar(None, output.type))
    return pc.replace_with_mask(plain, whole, text)


def in_slabs(texts: pa.Array, *others: pa.Array):
    """Parts of a batch that hold a few MB of text each, with the same rows of the other columns.

    Rows are copied, not sliced: pyarrow's if_else reads past the texts of an array that starts inside another.
    """
    for a, b in slabs(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        rows = pa.array(np.arange(a, b))
        yield [x.take(rows) for x in (texts, *others)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """`docs` with n (units), form, prefix_chars, middle_chars and output."""
    names = [f for f, _, _ in _FIELDS]
    kind = pa.struct([pa.field(f, t) for f, _, t in _FIELDS])

    @F.arrow_udf("struct<" + ",".join(f"{f}:{t}" for f, t, _ in _FIELDS) + ">")
    def over(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array) -> pa.Array:
        parts = [infilled(some, [x.to_numpy() for x in h], fim_percent, spm_percent)
                 for some, *h in in_slabs(pc.fill_null(texts, ""), h1, h2, h3, h4)]
        columns = [pa.concat_arrays(c) for c in zip(*parts, strict=True)] or [pa.array([], f.type) for f in kind]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    (found,) = fresh(docs, "_found")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    made = docs.withColumn(found, over(F.col(text), *draws(doc_id, seed)))
    return made.select(*rest, *[F.col(found)[f].alias(f) for f in names])


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """`rows` with restored, the text rebuilt from output and form."""

    @F.arrow_udf("string")
    def over(outputs: pa.Array, forms: pa.Array) -> pa.Array:
        parts = [rebuilt(some, form_of) for some, form_of in in_slabs(outputs, forms)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return rows.withColumn("restored", over(F.col(output), F.col(form)))
