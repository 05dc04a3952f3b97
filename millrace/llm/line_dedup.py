"""Line deduplication with a sharded minimal perfect hash.

1. Every document gives its distinct line digests (128 bits); they are counted
   per digest with a map-side combine, together with the largest document id.
2. Digests in at least ``min_docs`` documents are dealt over shards. A shard is
   one row: a minimal perfect hash and, in its order, arrays of 64-bit
   fingerprints, counts and holders.
3. Documents probe the arrays of a line's shard. The ``HEAVY`` most frequent
   lines form one more shard that every task carries (at most ``HEAVY`` rows,
   whatever the input), so no shard sees a line of more than 1 / ``HEAVY`` of
   all line occurrences.
4. Digests to drop are gathered per document and its text is rebuilt.

NULL or empty texts are one empty line. A NULL id counts as smaller than any
other; rows of one id count as separate documents and are treated alike. Empty
input gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, mix64, staged, utf8
from millrace.llm.perfect_hash import PerfectHash

#: Stripped from both ends of a line before it is compared.
STRIP = b"\x20\x09\x0a\x0b\x0c\x0d"

#: Most frequent lines resolved inside every task.
HEAVY = 1024

#: Lines per shard of the index at most, about.
SHARD_KEYS = 1 << 15

#: Smallest long: stands for a NULL id among holders.
NO_ID = -(1 << 63)


def digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of a line's key; None when the key is too short to count."""
    key = line.strip(STRIP).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Shard:
    """Perfect hash of some lines with fingerprint, count and holder arrays."""

    def __init__(self, hashed: PerfectHash, fingerprints, counts, holders):
        self.hashed, self.fingerprints, self.counts, self.holders = hashed, fingerprints, counts, holders

    @classmethod
    def build(cls, high, low, counts, holders) -> "Shard":
        hashed = PerfectHash.build(high, low)
        at = hashed.index(high, low)
        order = np.argsort(at)
        return cls(hashed, low[order], counts[order].astype(np.uint32), holders[order])

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (self.hashed.pack(), *(x.tobytes() for x in (self.fingerprints, self.counts, self.holders)))

    @classmethod
    def unpack(cls, hashed, fingerprints, counts, holders) -> "Shard":
        return cls(
            PerfectHash.unpack(hashed), np.frombuffer(fingerprints, np.uint64),
            np.frombuffer(counts, np.uint32), np.frombuffer(holders, np.int64),
        )

    def probe(self, high, low, ids) -> tuple[np.ndarray, np.ndarray]:
        """(line is indexed, line is to be dropped from the document)."""
        at = self.hashed.index(high, low)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == low[known]
        drop = known.copy()
        drop[known] = self.holders[at[known]] != ids[known]
        return known, drop


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = {digest(line, min_chars) for line in text.split(b"\n")}
                found.discard(None)
                digests.extend(found)
                ids.extend([doc] * len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["id", "line"]
            )

    return run


def _probe_heavy(min_chars: int, heavy: tuple[bytes, ...], shards: int):
    """Settle lines of the heavy shard; give every other line its shard.

    Texts become lines in the same function: a second one in the task would keep a second Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Shard.unpack(*heavy)
        for batch in _lines(min_chars)(batches):
            lines = batch.column(1)
            if not len(lines):
                continue
            high, low = _halves(lines.to_pylist())
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            known, drop = index.probe(high, low, ids)
            keep = ~known | drop
            # Settled rows only pass through the exchange: deal them by document.
            spread = np.where(known, mix64(ids.view(np.uint64)), high.byteswap()) % np.uint64(shards)
            chosen = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(spread[keep].astype(np.int32)),
                    pa.array(drop[keep]),
                    batch.column(0).filter(chosen),
                    lines.filter(chosen),
                ],
                ["shard", "settled", "id", "line"],
            )

    return run


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    high, low = _halves(list(pdf["line"]))
    packed = Shard.build(high, low, pdf["docs"].to_numpy(), pdf["holder"].to_numpy()).pack()
    return pd.DataFrame([(int(pdf["shard"].iloc[0]), *packed)], columns=["shard", "mph", "prints", "counts", "holders"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, the shard's index row first."""
    shard, index = None, None
    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.diff(numbers)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(numbers)]):
            part = batch.slice(lo, hi - lo)
            if not len(part):
                continue
            if numbers[lo] != shard:
                shard, index = numbers[lo], None
            if part.column("mph")[0].is_valid:
                index = Shard.unpack(*(part.column(c)[0].as_py() for c in ("mph", "prints", "counts", "holders")))
                part = part.slice(1)
            if not len(part):
                continue
            drop = part.column("settled").to_numpy(zero_copy_only=False).astype(bool)
            if index is not None:
                high, low = _halves(part.column("line").to_pylist())
                drop |= index.probe(high, low, part.column("id").fill_null(NO_ID).to_numpy())[1]
            chosen = pa.array(drop)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").filter(chosen), part.column("line").filter(chosen)], ["id", "line"]
            )


def _rebuild(min_chars: int):
    @F.pandas_udf("struct<kept string, lines long, dropped long>")
    def rebuild(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, drops):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            kept = lines
            if drop is not None:
                gone = set(drop)
                kept = [line for line in lines if digest(line, min_chars) not in gone]
            out.append((b"\n".join(kept).decode("utf-8", "replace"), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "lines", "dropped"])

    return rebuild


def line_index(lines: DataFrame, min_docs: int, shards: int) -> tuple[DataFrame, tuple[bytes, ...], int]:
    """Index rows per shard, the packed shard of the heavy lines, and the number of shards."""
    counted = staged(
        lines.groupBy("line")
        .agg(F.count("*").alias("docs"), F.coalesce(F.max("id"), F.lit(NO_ID)).alias("holder"))
        .where(F.col("docs") >= min_docs),
        "line-counts",
    )
    top = counted.orderBy(F.desc("docs"), "line").limit(HEAVY).toPandas()
    high, low = _halves(list(top["line"]))
    heavy = Shard.build(high, low, top["docs"].to_numpy(np.int64), top["holder"].to_numpy(np.int64)).pack()
    shards = max(shards, counted.count() // SHARD_KEYS)
    # Same shard as in _probe_heavy: the first eight bytes, big-endian, modulo the shards.
    number = F.conv(F.hex(F.substring("line", 1, 8)), 16, 10).cast("decimal(20,0)")
    dealt = counted.withColumn("shard", F.pmod(number, F.lit(shards)).cast("int"))
    index = dealt.groupBy("shard").applyInPandas(
        _build_shard, "shard int, mph binary, prints binary, counts binary, holders binary"
    )
    return index, heavy, shards


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 3,
    min_chars: int = 20,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the rebuilt text and the number of lines before and dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of ``min_chars`` code points or more found in ``min_docs`` documents
    or more stay only in the document with the largest id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = texts.mapInArrow(_lines(min_chars), "id long, line binary")
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    index, heavy, shards = line_index(lines, min_docs, shards)

    marked = texts.mapInArrow(
        _probe_heavy(min_chars, heavy, shards), "shard int, settled boolean, id long, line binary"
    )
    arrays = ("mph", "prints", "counts", "holders")
    both = index.select(
        "shard", F.lit(False).alias("settled"), F.lit(None).cast("long").alias("id"),
        F.lit(None).cast("binary").alias("line"), *arrays,
    ).unionByName(marked.select("*", *(F.lit(None).cast("binary").alias(c) for c in arrays)))
    gone = (
        both.repartition("shard")
        .sortWithinPartitions("shard", F.col("mph").isNull())
        .mapInArrow(_probe, "id long, line binary")
    )
    key, drops, made = fresh("id"), fresh("drops"), fresh("made")
    per_doc = gone.groupBy(F.col("id").alias(key)).agg(F.collect_list("line").alias(drops))
    joined = docs.join(per_doc, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left")
    rebuilt = joined.withColumn(made, _rebuild(min_chars)(F.col(text_col).cast("string"), F.col(drops)))
    return (
        rebuilt.withColumn(text_col, F.col(f"{made}.kept"))
        .withColumn(lines_col, F.col(f"{made}.lines"))
        .withColumn(dropped_col, F.col(f"{made}.dropped"))
        .drop(key, drops, made)
    )
