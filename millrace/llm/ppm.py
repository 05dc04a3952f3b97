"""Language-model scoring by prediction by partial matching over bytes.

Texts are lower-cased (A-Z), their words joined by single spaces and closed by
an end byte. Counting:

* words: each task counts its training words, Spark sums them per word;
* contexts: each task counts the grams of ``ORDER`` + 1 bytes, Spark sums them; shorter
  contexts are sums of longer ones, so every training document is in every count.

The trie lies in one table per order, every gram that was counted with its context's
total and number of symbols; no gram is left out. A symbol's probability is (n - 1/2) /
total in the longest context that has it; a context without it escapes with the mass
that is left to the next shorter one, where the symbols of the longer context are
excluded and the rest renormalised. Below the empty context all bytes are equally likely.

The ``HOT_GRAMS`` most frequent full grams are carried by every task and settle most
bytes; they are a cache and change no result. The other grams of a document are met in
a join. Those that training never saw are taken once each and go down the orders, a join
with the contexts' escapes and one with the grams of the next order at a time.

Word counts for the unigram base come from at most ``HOT`` frequent words that every task
carries and, for all others, from a join on the word.

NULL and empty texts are the end alone. Without training documents the model is
uniform over bytes. Sums are kept in fixed point or per document, so that equal texts have
equal scores. Rows of one id are scored one by one. Empty input gives an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import staged, utf8

ORDER = 6
#: Full grams and words that every task carries.
HOT_GRAMS, HOT = 1 << 21, 200_000
#: Log probabilities are summed over rows as multiples of 1 / FIXED.
FIXED = 1 << 32
#: Grams sorted at once, and distinct ones a task holds before it hands them on.
SORTED, HELD = 1 << 21, 1 << 22
#: Distinct words a task holds before it hands them on.
HELD_WORDS = 400_000
#: Bytes scored at once.
BLOCK = 1 << 20

END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text; bytes.lower() and bytes.split() know ASCII only."""
    return text.lower().split()


def grams(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ORDER + 1 bytes that end at every byte, and the number of bytes per sequence."""
    lengths = np.array([len(s) for s in sequences], np.int64)
    pad = END * ORDER
    data = np.frombuffer(pad + pad.join(sequences), np.uint8).astype(np.uint64)
    codes = np.zeros(len(data) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        codes <<= np.uint64(8)
        codes |= data[i : len(data) - ORDER + i]
    ends = np.cumsum(lengths + ORDER) - ORDER
    keep = np.ones(len(codes), bool)
    for i in range(ORDER):
        # Places whose last byte is padding before the next sequence.
        keep[(ends[:-1] + i)] = False
    return codes[keep], lengths


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def hand_on() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
        )

    held: Counter = Counter()
    for batch in batches:
        for text in utf8(batch.column(0)):
            held.update(tokens(text))
            if len(held) > HELD_WORDS:
                yield hand_on()
                held = Counter()
    yield hand_on()


def _sum_sorted(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(n, first)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[np.ndarray] = []

    def condense() -> None:
        if waiting:
            codes = np.sort(np.concatenate(waiting))
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            held.append((codes[first], np.diff(np.concatenate([first, [len(codes)]]))))
            waiting.clear()

    def hand_on() -> Iterator[pa.RecordBatch]:
        condense()
        if held:
            codes, n = _sum_sorted(np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            for at in range(0, len(codes), 1 << 17):
                part = slice(at, at + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes[part].view(np.int64)), pa.array(n[part])], ["code", "n"]
                )

    size = 0
    for batch in batches:
        for some in _slices([b" ".join(tokens(t)) + END for t in utf8(batch.column(0))]):
            codes, _ = grams(some)
            waiting.append(codes)
            size += len(codes)
            if size >= SORTED:
                condense()
                size = 0
            if sum(len(c) for c, _ in held) > HELD:
                yield from hand_on()
    yield from hand_on()


def _slices(sequences: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of sequences of about BLOCK bytes."""
    some, size = [], 0
    for sequence in sequences:
        some.append(sequence)
        size += len(sequence)
        if size >= BLOCK:
            yield some
            some, size = [], 0
    if some:
        yield some


class Table:
    """Values of 64-bit codes: codes lie by their hash, a directory gives each hash range's start."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        self.bits = max(1, int(len(codes)).bit_length())
        hashed = self._hash(codes)
        order = np.argsort(hashed, kind="stable")
        self.codes, self.values = codes[order], values[order]
        counts = np.bincount(hashed, minlength=1 << self.bits)
        self.start = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        self.longest = int(counts.max(initial=0))

    def _hash(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) per code."""
        hashed = self._hash(codes)
        at, end = self.start[hashed], self.start[hashed + 1]
        found, values = np.zeros(len(codes), bool), np.zeros(len(codes))
        todo = np.flatnonzero(at < end)
        for step in range(self.longest):
            place = at[todo] + step
            hit = self.codes[place] == codes[todo]
            found[todo[hit]] = True
            values[todo[hit]] = self.values[place[hit]]
            todo = todo[~hit]
            todo = todo[at[todo] + step + 1 < end[todo]]
            if not len(todo):
                break
        return found, values


def _mask(count: int) -> np.uint64:
    return np.uint64((1 << (8 * count)) - 1)


def _most_frequent(table: DataFrame, count: Column, most: int) -> int:
    """Smallest count that at most ``most`` rows reach."""
    # One row per distinct count: about the square root of the sum of all counts.
    steps = table.groupBy(count.alias("n")).agg(F.count("*").alias("rows")).toPandas().sort_values("n", ascending=False)
    if not len(steps):
        return 1
    inside = steps["rows"].cumsum() <= most
    return int(steps["n"][inside].min()) if inside.any() else int(steps["n"].max()) + 1


def _low(code: Column, count: int) -> Column:
    return code.bitwiseAND(F.lit(int(_mask(count))))


def _context(code: Column) -> Column:
    return F.shiftrightunsigned(code, 8)


def train_trie(training: DataFrame) -> list[DataFrame]:
    """Per order 0 to ``ORDER``: (code, context, n, total, kinds) of all grams in a text column.

    ``total`` and ``kinds`` are the occurrences and the distinct symbols of the context.
    """
    counted = training.mapInArrow(_count_grams, "code long, n long")
    levels: list[DataFrame] = []
    for order in range(ORDER, -1, -1):
        here = W.partitionBy("context")
        # One exchange: the rows of a context (256 symbols at most) stay together for both steps.
        level = (
            counted.select("code", "n", _context(F.col("code")).alias("context"))
            .repartition("context")
            .groupBy("context", "code").agg(F.sum("n").alias("n"))
            .withColumns({"total": F.sum("n").over(here), "kinds": F.count("*").over(here)})
        )
        levels.insert(0, staged(level.select("code", "context", "n", "total", "kinds"), "ppm-level"))
        counted = levels[0].select(_low(F.col("code"), order).alias("code"), "n")
    return levels


def _log_probability() -> Column:
    return F.log10((F.col("n") - 0.5) / F.col("total"))


def _escapes(levels: list[DataFrame], order: int, wanted: DataFrame) -> DataFrame:
    """(context, escape): log10 weight of leaving each ``wanted`` context for the next shorter one.

    Mass left by its symbols, over the mass that these symbols do not take in the shorter context.
    """
    grams_ = levels[order].join(wanted, "context", "left_semi")
    one = F.lit(1).cast("long")
    if order:
        shorter = levels[order - 1].select(
            F.col("code").alias("short"), F.col("n").alias("short_n"), F.col("total").alias("short_total")
        )
        grams_ = grams_.join(shorter, _low(F.col("code"), order) == F.col("short"))
        free = 2 * F.max("short_total") - F.sum(2 * F.col("short_n") - 1)
        whole = 2 * F.max("short_total")
    else:
        free, whole = 256 - F.count("*"), F.lit(256)
    return grams_.groupBy("context").agg(
        F.log10(F.max("kinds") / (2 * F.max("total")) * whole / F.greatest(free, one)).alias("escape")
    )


def unseen_values(codes: DataFrame, levels: list[DataFrame]) -> list[DataFrame]:
    """(code, value) of distinct full grams that training does not have: log10 of the last byte's probability."""
    done, todo = [], staged(codes.select("code", F.lit(0.0).alias("value")), "ppm-unseen")
    for order in range(ORDER, -1, -1):
        if not todo.head(1):
            return done
        asked = todo.withColumn("context", _context(_low(F.col("code"), order + 1)))
        escapes = _escapes(levels, order, asked.select("context").distinct())
        left = asked.join(escapes, "context", "left").select(
            "code", (F.col("value") + F.coalesce("escape", F.lit(0.0))).alias("value")
        )
        if order:
            shorter = levels[order - 1].select(F.col("code").alias("short"), _log_probability().alias("p"))
            left = left.join(shorter, _low(F.col("code"), order) == F.col("short"), "left")
        else:
            left = left.withColumn("p", F.lit(-math.log10(256)))
        met = staged(
            left.select("code", (F.col("value") + F.coalesce("p", F.lit(0.0))).alias("value"), F.col("p").isNotNull().alias("met")),
            "ppm-unseen",
        )
        done.append(met.where("met").select("code", "value"))
        todo = met.where("not met").select("code", "value")
    return done


def _hot_grams(level: DataFrame) -> Table:
    """The most frequent full grams, at most HOT_GRAMS, with their log10 probabilities."""
    cut = _most_frequent(level, F.col("n"), HOT_GRAMS)
    frequent = level.where(F.col("n") >= cut).select("code", _log_probability().alias("value")).toArrow()
    return Table(frequent["code"].to_numpy().view(np.uint64), frequent["value"].to_numpy())


def _settle(hot: Table | None, sequences: list[bytes]) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Per sequence: score of its hot grams; the other grams and how often each occurs."""
    scores, per_row, cold, times = [], [], [], []
    for some in _slices(sequences) if hot is not None else ():
        codes, lengths = grams(some)
        owner = np.repeat(np.arange(len(some)), lengths)
        found, value = hot.find(codes)
        # Added up in the order of the text, whatever stands beside it.
        scores.append(np.bincount(owner, weights=value, minlength=len(some)))
        codes, owner = codes[~found], owner[~found]
        by = np.lexsort((codes, owner))
        codes, owner = codes[by], owner[by]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        cold.append(codes[first])
        times.append(np.diff(np.append(first, len(codes))))
        per_row.append(np.bincount(owner[first], minlength=len(some)))
    if not scores:
        scores = [np.array([-math.log10(256) * len(s) for s in sequences])]
        per_row, cold, times = [np.zeros(len(sequences), np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    offsets = pa.array(np.append(0, np.cumsum(np.concatenate(per_row))), pa.int32())
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(x))
        for x in (np.concatenate(cold).view(np.int64), np.concatenate(times).astype(np.int64))
    ]
    return np.concatenate(scores), *lists


def _score(shared, learned):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_grams, hot = shared.value
        for batch in batches:
            texts = utf8(batch.column("text"))
            for at in range(0, len(texts), 512):
                words = [tokens(t) for t in texts[at : at + 512]]
                values = [list(map(hot.get, w)) for w in words]
                cold = [Counter(w for w, v in zip(ws, vs) if v is None) for ws, vs in zip(words, values)]
                scores, grams_, gram_times = _settle(hot_grams, [b" ".join(w) + END for w in words])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(at, 512) for c in learned),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([len(vs) - sum(c.values()) for vs, c in zip(values, cold)], pa.int64()),
                        pa.array([math.fsum(v for v in vs if v is not None) for vs in values], pa.float64()),
                        pa.array(scores, pa.float64()),
                        pa.array([list(c) for c in cold], pa.list_(pa.binary())),
                        pa.array([list(c.values()) for c in cold], pa.list_(pa.int64())),
                        grams_,
                        gram_times,
                    ],
                    [*learned, "n_words", "n_hot", "hot_score", "score", "cold", "times", "grams", "gram_times"],
                )

    return run


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: id, trained_on, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(training, F.lit(False)).alias("trained_on"),
        F.col(text_col).cast("string").alias("text"),
    )
    learned = base.where("trained_on").select("text")
    vocabulary = staged(
        learned.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words"
    )
    ends = learned.count()
    sums = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, distinct = sums[0] + ends, sums[1] + (1 if ends else 0)
    log_den = math.log10(n_all + 0.5 * (distinct + 1))
    cut = _most_frequent(vocabulary, F.col("n"), HOT)
    frequent = vocabulary.where(F.col("n") >= cut).toArrow()  # at most HOT rows
    logs = np.log10(frequent["n"].to_numpy() + 0.5) - log_den
    hot = dict(zip(frequent["word"].to_pylist(), logs.tolist()))
    del frequent
    levels = train_trie(learned) if ends else []
    shared = docs.sparkSession.sparkContext.broadcast((_hot_grams(levels[-1]) if ends else None, hot))
    scored = staged(
        base.mapInArrow(
            _score(shared, ["id", "trained_on"]),
            "id long, trained_on boolean, n_words long, n_hot long, hot_score double, score double, "
            "cold array<binary>, times array<long>, grams array<long>, gram_times array<long>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "ppm-scored",
    )
    fixed = lambda value: F.round(value * FIXED).cast("long") * F.col("times")
    listed = lambda items, times: F.explode(F.arrays_zip(items, times))
    words = scored.select("row", listed("cold", "times").alias("c")).select(
        "row", F.col("c.cold").alias("word"), F.col("c.times").alias("times")
    ).join(vocabulary, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = words.select(
        "row",
        fixed(F.log10(F.col("n") + 0.5) - F.lit(log_den)).alias("base"),
        F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"),
        F.lit(0).cast("long").alias("model"),
    )
    if ends:
        rare = scored.select("row", "trained_on", listed("grams", "gram_times").alias("c")).select(
            "row", "trained_on", F.col("c.grams").alias("code"), F.col("c.gram_times").alias("times")
        )
        # What a training document holds was counted.
        unseen = rare.where("not trained_on").select("code").distinct().join(levels[-1], "code", "left_anti")
        values = levels[-1].select("code", _log_probability().alias("value"))
        for more in unseen_values(unseen, levels):
            values = values.unionByName(more)
        sums = sums.unionByName(
            rare.join(values, "code").select(
                "row", F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("known"),
                fixed(F.col("value")).alias("model"),
            )
        )
    rest = sums.groupBy("row").agg(
        *(F.sum(c).alias(f"rare_{c}") for c in ("base", "known", "model"))
    )
    none = F.lit(0).cast("long")
    end_score = math.log10(ends + 0.5) - log_den
    return scored.drop("cold", "times", "grams", "gram_times").join(rest, "row", "left").select(
        "id",
        "trained_on",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_hot") + F.coalesce("rare_known", none) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_base", none) / FIXED + F.lit(end_score)).alias("base_score"),
        (F.col("score") + F.coalesce("rare_model", none) / FIXED).alias("score"),
    )
