"""Text scans whose findings are proven: check digits and value ranges behind patterns, and phrase lists of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: shapes of candidates (Java and RE2 read them alike) --------------
CANDIDATES = {
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "ipv4": r"\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
# ----------------------------------------------------------------------------------


def _digits(text: Column) -> Column:
    """Digits of a text as an array of ints."""
    return F.transform(F.split(text, ""), lambda c: c.cast("int"))


def luhn(number: Column) -> Column:
    """Whether a text of digits ends in its Luhn check digit."""
    backwards = F.reverse(_digits(number))
    weighed = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (no blanks) leaves 1 modulo 97, with its first four signs last and letters as 10 to 35."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (F.when(c.rlike("[0-9]"), a * 10).otherwise(a * 100) + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def proven(kind: str, found: Column) -> Column:
    """Whether a candidate of a kind is one: check digits of cards and accounts, octets, parts of a number that are given out."""
    bare = F.regexp_replace(found, "[ -]", "")
    parts = F.split(found, "[.-]")
    if kind == "card":
        return luhn(bare) & ~bare.rlike("^0+$")
    if kind == "iban":
        return mod97(bare)
    if kind == "ipv4":
        return F.forall(parts, lambda p: p.cast("int") <= 255)
    area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
    return (area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000")


def scan_proven(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, kind, candidates, proven) of every row and kind with a candidate; a narrow map over whole texts."""
    each = F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("found"))
        for kind, pattern in CANDIDATES.items()
    ])
    rows = df.select(*keys, F.inline(each)).where(F.size("found") > 0)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: F.coalesce(proven(kind, x), F.lit(False))))

    good = F.lit(None).cast("int")
    for kind in CANDIDATES:
        good = F.when(F.col("kind") == kind, count(kind)).otherwise(good)
    return rows.select(*keys, "kind", F.size("found").alias("candidates"), good.alias("proven"))


def normal_words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _run_hashes(lengths: Sequence[int] | None):
    """128-bit hashes of the runs of ``lengths`` words of an array of words; None: of the whole array as one run.

    A word is hashed once per batch, and a run is made of the hashes of its words, all rows side by side.
    """

    @F.arrow_udf("array<struct<one:bigint,two:bigint>>")
    def hashes(texts: pa.Array) -> pa.Array:
        words = texts.flatten().dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.cast(pa.binary()).to_pylist())
        halves = np.frombuffer(digests, np.uint64).reshape(-1, 2)[words.indices.to_numpy()]
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(halves))
        row = np.repeat(np.arange(len(sizes)), sizes)
        found, rows = [], []
        for n in lengths if lengths is not None else np.unique(sizes[sizes > 0]):
            # Words left in the row at the start of a run.
            at = np.flatnonzero(left >= n if lengths is not None else (left == n) & (sizes[row] == n))
            run = np.zeros((len(at), 2), np.uint64) + np.uint64(n)
            for i in range(n):
                run = _mixed(run * np.uint64(0x9E3779B97F4A7C15) + halves[at + i])
            found.append(run)
            rows.append(row[at])
        runs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
        owner = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        runs = runs[np.argsort(owner, kind="stable")].view(np.int64)
        counts = np.bincount(owner, minlength=len(sizes))
        one, two = (pa.array(np.ascontiguousarray(runs[:, k])) for k in (0, 1))
        values = pa.StructArray.from_arrays([one, two], ["one", "two"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)

    return hashes


def phrase_hits(df: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str, topic: str) -> DataFrame:
    """(keys, ``topic``, hits) of rows whose words hold phrases of a table of any size: how many different ones of each topic.

    A phrase is a run of whole words. Texts give the hashes (128 bits) of their runs of as many words as the phrases have; these meet
    the phrases in an equi-join, so neither the plan nor the work per text grows with the list. Equal runs of a text count once.
    """
    listed = phrases.select(normal_words(F.col(phrase)).alias("w"), F.col(topic)).where(F.size("w") > 0).select(
        F.size("w").alias("n"), topic, F.inline(_run_hashes(None)("w"))).distinct()
    # A few small numbers.
    lengths = sorted(r[0] for r in listed.select("n").distinct().collect())
    # Runs that are no phrase end in the join; only hits are made distinct.
    runs = df.select(*keys, F.inline(_run_hashes(lengths)(normal_words(F.col(text)))))
    met = runs.join(listed, ["one", "two"]).distinct()
    return met.groupBy(*keys, topic).agg(F.count(F.lit(1)).alias("hits"))
