"""Fill-in-the-middle: texts cut at two units and reordered for training.

A unit is a run of ASCII letters or any other single code point. One full match of
``(unit)*`` keeps every repetition of its group, so the ends of the captures are the
ends of all units: their number is n, and the two cuts are looked up by position.
Python hands on three numbers a row; pieces, output and the way back are Spark functions.

The cuts and the form are drawn from the sha256 of ``seed:id``, so a run repeats itself.

* NULL texts are empty, and empty texts are ``plain`` with n = 0.
* A text that holds one of the sentinels stays ``plain``, so that outputs can be undone.
* Rows are treated alone: repeated rows and ids give repeated rows; a NULL id
  draws from ``seed:``. Empty input gives an empty result.
* All input columns are kept; one named like the result is replaced by it.
* Very long texts are matched whole; the task needs some 60 bytes a unit of one text at a time.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Possessive, so that nothing is kept for backing up: no unit can be matched another way.
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")

CUTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "first", "second")])


def cuts(text: str, one: int, two: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle) in code points, for two drawn numbers."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    low, high = sorted((one % (n + 1), two % (n + 1)))
    return n, ends[low - 1] if low else 0, ends[high - 1] if high else 0


@F.arrow_udf(CUTS)
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    # Bytes that are no UTF-8 count one code point each and survive.
    found = [
        cuts(t.as_py().decode("utf-8", "surrogateescape"), a, b)
        for t, a, b in zip(text, one.to_pylist(), two.to_pylist())
    ]
    columns = zip(*found) if found else ([], [], [])
    return pa.StructArray.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["n", "first", "second"])


def drawn(seed: int, key: Column, position: int) -> Column:
    """Unsigned number of the ``position``-th (from 1) 8 hex digits of sha256("seed:key")."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * position - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "fim", seed: int = 1,
    plain_percent: int = 10, spm_percent: int = 20,
) -> DataFrame:
    """``docs`` with a struct ``out``: n, form, prefix_chars, middle_chars (NULL if plain) and output.

    ``plain_percent`` of the texts stay as they are; of the others ``spm_percent`` put the suffix first (``spm``), the rest the
    prefix (``psm``).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.col(id_col)
    cut = _cuts(text.cast("binary"), drawn(seed, key, 1), drawn(seed, key, 2))
    n, first, second = (cut.getField(c) for c in ("n", "first", "second"))
    whole = text == ""
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        whole |= text.contains(sentinel)
    form = F.when(whole | (drawn(seed, key, 3) % 100 >= 100 - plain_percent), "plain").otherwise(
        F.when(drawn(seed, key, 4) % 100 < spm_percent, "spm").otherwise("psm")
    )
    at = lambda start, length: F.substr(text, start.cast("int"), length.cast("int"))
    prefix = at(F.lit(1), first)
    middle = at(first + 1, second - first)
    suffix = at(second + 1, F.length(text) - second)
    mark = {c: F.lit(c) for c in (PREFIX, SUFFIX, MIDDLE)}
    output = (
        F.when(form == "plain", text)
        .when(form == "psm", F.concat(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle))
        .otherwise(F.concat(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle))
    )
    return docs.withColumn(out, F.struct(
        n.alias("n"), form.alias("form"),
        F.when(form != "plain", first).alias("prefix_chars"),
        F.when(form != "plain", second - first).alias("middle_chars"),
        output.alias("output"),
    ))


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from.

    No piece holds a sentinel, and none can arise over a border since a sentinel's last
    code point never begins one: the first occurrence of each is the one put in.
    """
    def pieces(first: str, second: str) -> tuple[Column, Column, Column]:
        """Between the first and the second sentinel, from there to the middle, and the middle."""
        two, three = F.locate(second, output), F.locate(MIDDLE, output)
        start = len(first) + 1
        between = lambda a, b: F.substr(output, a, b - a)
        after = two + len(second)
        return (
            between(F.lit(start), two), between(after, three),
            F.substr(output, three + len(MIDDLE), F.length(output)),
        )

    prefix, suffix, middle = pieces(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = pieces(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
