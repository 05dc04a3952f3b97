"""Lexical retrieval packing: a sharded BM25 inverted index fills the windows.

1. Texts are tokenised once into a table (ids, and per task the number of
   documents each id occurs in; their sum is one vector of vocabulary length).
2. A document's whole windows are sequences of their own. Its rest is dealt to
   a shard by its most telling id, salted by that id's document count so that
   no shard gets a common one whole.
3. A task reads its shards in blocks of ``BLOCK`` rests, builds an inverted index of
   each block (BM25 weights with the counts of the whole corpus) and packs
   greedily: the seed's best unused neighbours fill its window, the one
   that does not fit is cut and its remainder is the next seed.
4. Only a task's last window can stay open; it is cut into sequences whose lengths are
   powers of two, so nothing is padded.

NULL and empty texts are the end id alone. Documents of any length are cut
freely. NULL ids and repeated rows are packed like any other. Empty input gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import mix64, staged
from millrace.llm.tokens import Encoder

WINDOW = 2048
#: Rests indexed together.
BLOCK = 512
#: Documents per cell of a telling id, about.
CELL = 256
#: BM25: saturation of repeats, and weight of the length.
K1, B = 1.2, 0.75

TOKENS = "id long, ids binary, n long, df binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _tally(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (high, low) in order, and how often each occurs; ``low`` has ``bits`` bits.

    One sort for all documents of a block: pairs are packed into as few bytes as hold them.
    """
    if not len(high):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.uint32 if int(high.max()).bit_length() + bits <= 32 else np.uint64
    key = high.astype(kind)
    key <<= kind(bits)
    key |= low.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    pairs = key[first]
    return (
        (pairs >> kind(bits)).astype(np.int64), (pairs & kind((1 << bits) - 1)).astype(np.int64),
        np.diff(np.concatenate([first, [len(key)]])),
    )


def _numbers(arrays: list[np.ndarray]) -> np.ndarray:
    """Position of the array each element of their concatenation comes from."""
    return np.repeat(np.arange(len(arrays), dtype=np.uint32), [len(a) for a in arrays])


def _counts(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs."""
    ordered = np.sort(ids, kind="stable")
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.concatenate([first, [len(ordered)]]))


def _tokenise(end_id: int, *vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*vocabulary)
        end = np.array([end_id], encoder.dtype).tobytes()
        df = np.zeros(encoder.size, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            # Few documents at a time, so that long ones do not add up.
            for at in range(0, len(texts), 256):
                ids = [encoder.encode(t or "") + end for t in texts[at : at + 256]]
                arrays = [np.frombuffer(found, encoder.dtype) for found in ids]
                sizes = [len(a) for a in arrays]
                _, seen, _ = _tally(_numbers(arrays), np.concatenate(arrays), 8 * encoder.dtype.itemsize)
                df += np.bincount(seen, minlength=len(df))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()),
                     pa.nulls(len(ids), pa.binary())],
                    ["id", "ids", "n", "df"],
                )
        if df.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()),
                 pa.array([df.tobytes()], pa.binary())],
                ["id", "ids", "n", "df"],
            )

    return run


def _sum_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for vector in batch.column(0).to_pylist():
            array = np.frombuffer(vector, np.int64)
            total = array.copy() if total is None else total + array
    if total is not None:
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["token", "docs"])


def document_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """Documents per id: one number for each id of the vocabulary."""
    sums = (
        tokens.where(F.col("df").isNotNull()).select("df")
        .mapInArrow(_sum_vectors, "token long, docs long")
        .groupBy("token").agg(F.sum("docs").alias("docs"))
        .toPandas()  # at most one row per id of the vocabulary
    )
    out = np.zeros(size, np.int64)
    out[sums["token"].to_numpy(np.int64)] = sums["docs"].to_numpy(np.int64)
    return out


def _deal(dtype: str, idf: np.ndarray, df: np.ndarray, end_id: int):
    """Give every document the cell of its rest's most telling id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.copy()
        weights[end_id] = 0.0
        for batch in batches:
            # A document without a rest has a cell of its own.
            salts = mix64(batch.column(0).fill_null(-1).to_numpy().view(np.uint64))
            cells = (salts & np.uint64(0x3FFFFFFFFFFFFFFF)).astype(np.int64)
            found = batch.column(1).to_pylist()
            for at in range(0, len(found), 256):
                block = [np.frombuffer(x, dtype) for x in found[at : at + 256]]
                rests = [ids[len(ids) - len(ids) % WINDOW :] for ids in block]
                doc, token, times = _tally(_numbers(rests), np.concatenate(rests), 8 * rests[0].itemsize)
                if not len(doc):
                    continue
                telling = weights[token] * times / (times + K1)
                start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                # The first of the largest in each document's run.
                best = np.maximum.reduceat(telling, start)
                hit = np.flatnonzero(telling == np.repeat(best, np.diff(np.concatenate([start, [len(doc)]]))))
                hit = hit[np.concatenate([[True], doc[hit][1:] != doc[hit][:-1]])]
                row = at + doc[hit]
                salt = salts[row] % (df[token[hit]] // CELL + 1).astype(np.uint64)
                cells[row] = token[hit] << 32 | salt.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells), batch.column(0), batch.column(1)], ["cell", "id", "ids"]
            )

    return run


class _Index:
    """Inverted index of the rests of a block: ids, their documents and BM25 weights."""

    def __init__(self, rests: list[np.ndarray], idf: np.ndarray, average: float):
        self.rests = rests
        tokens, docs, times = _tally(np.concatenate(rests), _numbers(rests), max(1, (len(rests) - 1).bit_length()))
        lengths = np.array([len(r) for r in rests], np.float64)[docs]
        weight = idf[tokens] * times * (K1 + 1) / (times + K1 * (1 - B + B * lengths / average))
        self.docs, self.weights = docs, weight.astype(np.float32)
        start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.start = tokens[start], np.concatenate([start, [len(tokens)]])
        self.size = len(rests)

    def terms(self, at: int) -> np.ndarray:
        """Distinct ids of a rest."""
        return _counts(self.rests[at])[0].astype(np.int64)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.tokens, terms), len(self.tokens) - 1)
        found = at[self.tokens[at] == terms]
        lo, n = self.start[found], self.start[found + 1] - self.start[found]
        total = int(n.sum())
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return np.bincount(self.docs[place], self.weights[place], minlength=self.size)


class _Packer:
    """Windows of one task; pieces leave as soon as they are placed."""

    def __init__(self, idf: np.ndarray, average: float, first: int):
        self.idf, self.average, self.next = idf, average, first
        self.open: list[tuple] = []  # pieces of the open window
        self.sequence = -1  # its number
        self.filled = 0
        self.terms: np.ndarray | None = None  # of the open window's seed
        self.out: list[tuple] = []

    def whole(self, doc, ids, n) -> None:
        """Full windows of a document are sequences of their own."""
        for start in range(0, n - n % WINDOW, WINDOW):
            self.out.append((doc, start, ids[start : start + WINDOW], n, self._number(), 0))

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, doc, start: int, ids: np.ndarray, n: int) -> np.ndarray | None:
        """Place ids in the open window; what does not fit comes back."""
        if not self.filled:
            self.sequence = self._number()
        taken = ids[: WINDOW - self.filled]
        self.open.append((doc, start, taken, n, self.sequence, self.filled))
        self.filled += len(taken)
        if self.filled == WINDOW:
            self.out += self.open
            self.open, self.filled, self.terms = [], 0, None
        return ids[len(taken) :] if len(taken) < len(ids) else None

    def block(self, docs: list[tuple]) -> None:
        """Pack the rests of a block: (doc, start, ids, n)."""
        index = _Index([d[2] for d in docs], self.idf, self.average)
        unused = np.ones(len(docs), bool)
        next_ = 0
        queue: list[int] = []
        while True:
            if self.terms is None:
                while next_ < len(docs) and not unused[next_]:
                    next_ += 1
                if next_ == len(docs):
                    return
                self._seed(index, docs, unused, next_)
                queue = []
                continue
            if not queue:
                scores = np.where(unused, index.scores(self.terms), -1.0)
                queue = list(np.argsort(-scores, kind="stable")[: int(unused.sum())][::-1])
                if not queue:
                    return
            window = self.sequence
            self._take(index, docs, unused, queue.pop())
            if self.terms is None or self.sequence != window:
                queue = []

    def _seed(self, index, docs, unused, at: int) -> None:
        self.terms = index.terms(at)
        self._take(index, docs, unused, at)

    def _take(self, index, docs, unused, at: int) -> None:
        unused[at] = False
        doc, start, ids, n = docs[at]
        rest = self.put(doc, start, ids, n)
        if rest is not None:
            # The cut document is the seed of the next window.
            self.terms = index.terms(at)
            self.put(doc, start + len(ids) - len(rest), rest, n)

    def close(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        pieces, left = [list(p) for p in self.open], self.filled
        while left:
            room = length = 1 << (left.bit_length() - 1)
            while room:
                doc, start, ids, n, _, _ = pieces[0]
                taken = ids[:room]
                self.out.append((doc, start, taken, n, self.sequence, length - room))
                room -= len(taken)
                if len(taken) == len(ids):
                    pieces.pop(0)
                else:
                    pieces[0][1], pieces[0][2] = start + len(taken), ids[len(taken) :]
            left -= length
            self.sequence = self._number()
        self.open, self.filled, self.terms = [], 0, None

    def drain(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        docs, starts, ids, totals, sequences, offsets = zip(*out) if out else ((),) * 6
        return pa.RecordBatch.from_arrays(
            [
                pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), pa.array(totals, pa.int64()),
                pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64()),
            ],
            ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
        )


def _pack(dtype: str, idf: np.ndarray, average: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(idf, average, TaskContext.get().partitionId() << 40)
        rests: list[tuple] = []
        for batch in batches:
            for doc, found in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(found, dtype)
                packer.whole(doc, ids, len(ids))
                cut = len(ids) - len(ids) % WINDOW
                if cut < len(ids):
                    rests.append((doc, cut, ids[cut:].copy(), len(ids)))
                if len(rests) >= BLOCK:
                    packer.block(rests)
                    rests = []
                if len(packer.out) >= 1024:
                    yield packer.drain()
        if rests:
            packer.block(rests)
        packer.close()
        yield packer.drain()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    ranks_path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: its document, place there, ids (little-endian 32-bit), sequence and offset.

    ``ranks_path`` and ``pattern``: the same vocabulary as ranks, see ``tokens.Encoder``.
    """
    encoder = Encoder(tokenizer_path)
    dtype, size = encoder.dtype.str, encoder.size
    tokens = staged(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _tokenise(end_id, tokenizer_path, ranks_path, pattern), TOKENS
        ),
        "packing-tokens",
    )
    df = document_counts(tokens, size)
    totals = tokens.agg(F.count("n").alias("docs"), F.sum("n").alias("tokens")).first()
    count, average = totals["docs"], (totals["tokens"] or 1) / max(1, totals["docs"])
    idf = np.log1p((count - df + 0.5) / (df + 0.5))
    dealt = tokens.where(F.col("ids").isNotNull()).select("id", "ids").mapInArrow(
        _deal(dtype, idf, df, end_id), "cell long, id long, ids binary"
    )
    return (
        dealt.repartition("cell")
        .sortWithinPartitions("cell", "id")
        .mapInArrow(_pack(dtype, idf, min(average, WINDOW)), PIECES)
    )
