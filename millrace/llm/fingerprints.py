"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint holds the hashes of all word shingles that lie below a fixed
fraction of the hash space (1 / ``SCALE``). Which hashes are kept does not
depend on the document, so fingerprints of parts merge to that of the whole, and the share
of a small document's hashes found in a large one estimates containment. Texts
of up to ``SMALL`` distinct shingles keep every hash (scale 1); any comparison first cuts
both sides to the coarser scale.

As text a fingerprint is its scale, a colon, and its sorted hashes, sixteen hex
digits each. NULL texts count as empty; texts of fewer words than a shingle
are one shingle, texts without words none. A comparison for which
nothing is left at the common scale, though there were shingles, is NULL: not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import BLANK, fresh, staged

SHINGLE = 5
SCALE = 8
SMALL = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _below(scale: Column) -> Column:
    """Largest kept hash (as signed long) of a scale: 1 or ``SCALE``."""
    return F.when(scale == 1, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63) + (1 << 64) // SCALE - 1))


def shingle_hashes(text: Column) -> Column:
    """Hashes of all word shingles of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def joined(h: Column) -> Column:
        longer = F.transform(
            F.slice(h, 1, F.size(h) - (SHINGLE - 1)),
            lambda first, i: F.xxhash64(first, *(F.get(h, i + k) for k in range(1, SHINGLE))),
        )
        return (
            F.when(F.size(h) == 0, F.slice(h, 1, 0))
            .when(F.size(h) < SHINGLE, F.array(F.xxhash64(h)))
            .otherwise(longer)
        )

    return _let(hashed, joined)


def fingerprint(text: Column) -> Column:
    """struct(scale int, hashes array<long>) of a text."""

    def made(distinct: Column) -> Column:
        small = F.size(distinct) <= SMALL
        kept = F.when(small, distinct).otherwise(F.filter(distinct, lambda h: h <= _below(F.lit(SCALE))))
        return F.struct(
            F.when(small, F.lit(1)).otherwise(F.lit(SCALE)).alias("scale"), F.array_sort(kept).alias("hashes")
        )

    return _let(F.array_distinct(shingle_hashes(text)), made)


def as_text(print_: Column) -> Column:
    digits = F.transform(print_["hashes"], lambda h: F.lower(F.lpad(F.hex(h), 16, "0")))
    return F.concat(print_["scale"].cast("string"), F.lit(":"), F.array_join(digits, ""))


def merged(a: Column, b: Column) -> Column:
    """Fingerprint of two parts together, at the coarser of their scales."""
    scale = F.greatest(a["scale"], b["scale"])
    both = F.filter(F.array_union(a["hashes"], b["hashes"]), lambda h: h <= _below(scale))
    return F.struct(scale.alias("scale"), F.array_sort(both).alias("hashes"))


def _sizes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hashes of a, of b and of both at the common scale."""
    limit = _below(F.greatest(a["scale"], b["scale"]))
    count = lambda x: F.size(F.filter(x, lambda h: h <= limit))
    return count(a["hashes"]), count(b["hashes"]), count(F.array_intersect(a["hashes"], b["hashes"]))


def _none(print_: Column) -> Column:
    """Whether a text has no shingles at all; at a coarser scale no hashes do not say so."""
    return (print_["scale"] == 1) & (F.size(print_["hashes"]) == 0)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of both texts that they have in common.

    1.0 for two texts without shingles, 0.0 if one has none, NULL if no hash of either is left to compare.
    """
    in_a, in_b, shared = _sizes(a, b)
    return (
        F.when(_none(a) & _none(b), F.lit(1.0)).when(_none(a) | _none(b), F.lit(0.0))
        .otherwise(F.try_divide(shared.cast("double"), (in_a + in_b - shared).cast("double")))
    )


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has.

    1.0 for two texts without shingles, 0.0 if one has none, NULL if no hash of the first is left to compare.
    """
    in_a, _, shared = _sizes(a, b)
    return (
        F.when(_none(a) & _none(b), F.lit(1.0)).when(_none(a) | _none(b), F.lit(0.0))
        .otherwise(F.try_divide(shared.cast("double"), in_a.cast("double")))
    )


def _range_number(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below a value, found in two steps of about sqrt(bounds) each."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(b).cast("long") for b in bounds[step - 1 :: step]))
    fine = F.array(*(F.lit(b).cast("long") for b in bounds))
    skipped = F.size(F.filter(coarse, lambda b: b < value)) * step
    return skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), lambda b: b < value))


def with_following(docs: DataFrame, id_col: str, carried: list[str], prefix: str = "next_") -> DataFrame:
    """``docs`` with columns of the next row by descending id; after the last comes the first.

    Ids are cut into ranges of about equal counts; a window works inside a
    range, and the last row of a range gets the first row of the next one below
    from a table of one row per range. Equal ids come in the order of their carried
    values' hash. A NULL id comes last.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / ranges for i in range(1, ranges)]
    key, number, tie, tail = (fresh(x) for x in ("key", "range", "tie", "tail"))
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias(key))
    found = ids.agg(F.percentile_approx(key, shares, 10 * ranges).alias("b")).first()["b"] or []
    numbered = docs.withColumn(key, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
    bounds = sorted(set(found))
    numbered = numbered.withColumn(number, _range_number(F.col(key), bounds) if bounds else F.lit(0)).withColumn(
        tie, F.xxhash64(*carried)
    )
    order = [F.desc(key), F.col(tie)]
    # First row of each range: its largest id, and of equal ids the smallest tie.
    firsts = (
        numbered.groupBy(number).agg(F.max(F.struct(F.col(key), (-F.col(tie)).alias(tie))).alias("f"))
        .select(number, F.col(f"f.{key}").alias(key), (-F.col(f"f.{tie}")).alias(tie))
    )
    present = sorted(r[0] for r in firsts.select(number).collect())  # one number per range
    if not present:
        return docs.withColumns({f"{prefix}{c}": F.lit(None).cast(docs.schema[c].dataType) for c in carried})
    above = {below: present[i + 1] if i + 1 < len(present) else present[0] for i, below in enumerate(present)}
    receiver = F.create_map(*(F.lit(x) for pair in above.items() for x in pair))
    # One row per range: bounded by four times the number of shuffle partitions.
    heads = numbered.join(F.broadcast(firsts), [number, key, tie], "left_semi").dropDuplicates([number])
    heads = staged(
        heads.select(receiver[F.col(number)].alias(number), *(F.col(c).alias(f"{prefix}{c}") for c in carried)),
        "range-heads",
    )
    window = W.partitionBy(number).orderBy(*order)
    inner = numbered.withColumn(tail, F.lead(F.lit(1)).over(window).isNull()).withColumns(
        {f"{prefix}{c}": F.lead(c).over(window) for c in carried}
    )
    head = {c: fresh(c) for c in carried}
    renamed = heads.select(number, *(F.col(f"{prefix}{c}").alias(head[c]) for c in carried))
    # On the window's own key alone, so that the rows stay where they are.
    joined = inner.join(renamed, number, "left")
    return joined.withColumns(
        {f"{prefix}{c}": F.when(F.col(tail), F.col(head[c])).otherwise(F.col(f"{prefix}{c}")) for c in carried}
    ).drop(key, number, tie, tail, *head.values())


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its second half (the smaller, of code points) replaced by as many of the next
    document's first ones, by descending id. Returns id, n_chars, edited,
    print, edited_print, next_print.
    """
    plain = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    paired = with_following(plain, "id", ["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)
    )
    return paired.select(
        "id", n.cast("long").alias("n_chars"), edited.alias("edited"),
        fingerprint(F.col("text")).alias("print"), fingerprint(F.col("next_text")).alias("next_print"),
        fingerprint(edited).alias("edited_print"),
    )
