"""Near-duplicate classes with Order MinHash and banded alignment.

1. Equal texts are one: the row with the smallest id stands for them. Texts are numbered
   in the order of that id and their digest, so that rows of one id stay apart.
2. Shingles of ``SHINGLE`` words are labelled with their occurrence number. For each
   of ``SKETCHES`` hash functions the two smallest are kept in text order, so that
   a sketch depends on content and order. Each sketch is a bucket key of its own, so that
   texts that differ in a fifth of their words still meet.
3. A bucket links each member to its smallest id, so that most classes form without pairs.
   Then every two texts of one bucket that are not in one class yet are candidates too,
   whoever leads it. Members of one leader meet in cells of like length; a cell of more than
   ``TOGETHER`` members is cut into blocks and every two blocks are one task. Only what
   cannot be similar goes: texts whose lengths or counts of words in ``BINS`` bins need more
   edits than allowed (a bound, nothing is estimated).
4. Candidates are verified by banded alignment of their words: similar when the
   edit distance is at most (1 - ``threshold``) of the longer text. A banded
   distance is an upper bound; a pair is rejected only at the full band.
5. Classes are the connected components of the verified links.

NULL texts count as empty; texts without words are similar to equal texts only.
Texts of fewer words than a shingle are one shingle. Rows of one id with different
texts are different documents, a NULL id counts as the smallest. Empty input gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, mix64, ranked, staged, utf8

SHINGLE = 5
SKETCHES = 96
#: Members of a leader compared in one task come from two blocks of about this many texts and words at most.
TOGETHER, WORDS = 2_048, 1 << 21
#: Bins in which the words of a text are counted, to 255 each.
BINS = 512
#: Shingles hashed at once.
BLOCK = 1 << 15
#: First band of the alignment; the next ones are four times as wide each.
FIRST_BAND = 16
#: Pairs aligned side by side, and cells of their band at most.
SIDE_BY_SIDE, CELLS = 256, 1 << 16

NO_ID = -(1 << 63)

_FACTORS = (mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)


def word_hashes(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the word shingles, each labelled with its occurrence number."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    hashed = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        hashed = mix64(hashed ^ words[i : len(words) - width + 1 + i])
    order = np.argsort(hashed, kind="stable")
    ordered = hashed[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))
    occurrence = np.empty(len(hashed), np.uint64)
    occurrence[order] = (np.arange(len(ordered)) - start).astype(np.uint64)
    return mix64(hashed + occurrence * np.uint64(0x9E3779B97F4A7C15))


def sketch(words: np.ndarray) -> np.ndarray | None:
    """For each hash function, a hash of its two smallest shingles in text order."""
    shingles = labelled_shingles(words)
    if not len(shingles):
        return None
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    values = np.full((SKETCHES, 2), np.iinfo(np.uint32).max, np.uint32)
    places = np.zeros((SKETCHES, 2), np.int64)
    rows = np.arange(SKETCHES)
    for at in range(0, len(short), BLOCK):
        part = short[at : at + BLOCK]
        hashed = part[None, :] * _FACTORS[:, None]
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        for _ in range(min(2, len(part))):
            best = hashed.argmin(axis=1)
            found = hashed[rows, best]
            hashed[rows, best] = np.iinfo(np.uint32).max
            for slot in (0, 1):
                better = found < values[:, slot]
                if slot == 0:
                    # What was smallest so far becomes the second.
                    values[better, 1], places[better, 1] = values[better, 0], places[better, 0]
                    values[better, 0], places[better, 0] = found[better], best[better] + at
                    found = np.where(better, np.iinfo(np.uint32).max, found)
                else:
                    values[better, 1], places[better, 1] = found[better], best[better] + at
    if len(short) == 1:
        places[:, 1] = 0
    places.sort(axis=1)
    pairs = mix64(shingles[places[:, 0]] * np.uint64(0x9E3779B97F4A7C15) ^ shingles[places[:, 1]])
    return (pairs >> np.uint64(32)).astype(np.uint32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in utf8(batch.column("text")):
            made = sketch(word_hashes(text))
            found.append(None if made is None else made.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("digest"), pa.array(found, pa.binary())], ["id", "digest", "sketch"]
        )


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = np.arange(SKETCHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCHES)
        keys = mix64(numbers ^ flat.astype(np.uint64))
        ids = np.repeat(batch.column("id").to_numpy(), SKETCHES)
        at = np.tile(np.arange(SKETCHES, dtype=np.int32), len(flat))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids), pa.array(at)], ["key", "id", "at"]
        )


class _Cell:
    """Members of one leader and of like length; ``known`` names the class each is in."""

    COLUMNS = "leader long, cell long, lo int, hi int, block int, own boolean, known long, id long, low long, high long"

    def __init__(self, rows: pa.Table, threshold: float):
        self.rows = rows = rows.sort_by([("n", "ascending"), ("id", "ascending")])
        self.ids, self.n, self.own, self.block, known = (
            rows.column(c).to_numpy() for c in ("id", "n", "own", "block", "known")
        )
        self.known = known.copy()
        self.bins = np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(-1, BINS).astype(np.int16)
        self.flat = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCHES)
        self.masks = [rows.column(c).to_numpy() for c in ("low", "high")]
        self.across = rows.column("lo")[0] != rows.column("hi")[0]
        self.allowed = np.floor((1 - threshold) * self.n + 1e-9).astype(np.int64)
        self.first = np.searchsorted(self.n, self.n - self.allowed)

    def candidates(self, i: int) -> np.ndarray:
        """Shorter members of other classes that share a bucket with member ``i`` and may be similar to it.

        Two texts meet under the leader of the first bucket they share, and nowhere else.
        """
        lo = self.first[i]
        meet = (self.known[lo:i] != self.known[i]) & (self.own[lo:i] | self.own[i])
        if self.across:
            meet &= self.block[lo:i] != self.block[i]
        at = np.flatnonzero(meet) + lo
        if not len(at):
            return at
        # A replaced word moves two counts, an added or missing one moves one.
        edits = (np.abs(self.bins[at] - self.bins[i]).sum(axis=1, dtype=np.int32) + self.n[i] - self.n[at]) // 2
        at = at[edits <= self.allowed[i]]
        agree = self.flat[at] == self.flat[i]
        bucket = agree.argmax(axis=1)
        half = SKETCHES // 2
        led = np.where(bucket < half, self.masks[0][i] >> (bucket % half), self.masks[1][i] >> (bucket % half)) & 1
        return at[agree.any(axis=1) & (led == 1)]


def _open_members(threshold: float):
    """Members that have candidates."""

    def run(rows: pa.Table) -> pa.Table:
        cell = _Cell(rows, threshold)
        has = np.zeros(len(cell.ids), bool)
        for i in range(1, len(has)):
            at = cell.candidates(i)
            has[at] = True
            has[i] |= len(at) > 0
        names = [c.split()[0] for c in cell.COLUMNS.split(", ")]
        return cell.rows.select(names).filter(pa.array(has))

    return run


def _join_classes(threshold: float):
    """Links that join the classes of a cell: fewer than its members. Pairs that earlier ones have joined are not aligned."""

    def run(rows: pa.Table) -> pa.Table:
        cell = _Cell(rows, threshold)
        words = [np.frombuffer(w, np.uint32) for w in cell.rows.column("words").to_pylist()]
        known, waiting, links = cell.known, [], []

        def settle() -> None:
            pairs = [(i, j) for i, j in waiting if known[i] != known[j]]
            same = similar([words[i] for i, _ in pairs], [words[j] for _, j in pairs], threshold, words_first=True)
            for (i, j), ok in zip(pairs, same):
                if ok and known[i] != known[j]:
                    known[known == known[j]] = known[i]
                    links.append((cell.ids[i], cell.ids[j]))
            waiting.clear()

        for i in range(1, len(words)):
            waiting.extend((i, j) for j in cell.candidates(i))
            if len(waiting) >= SIDE_BY_SIDE:
                settle()
        settle()
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    return run


def banded_distances(
    left: list[np.ndarray], right: list[np.ndarray], band: int, limits: np.ndarray | None = None
) -> np.ndarray:
    """Upper bounds of the edit distances of pairs, aligned inside a band around the diagonal.

    Exact wherever the distance is at most ``band``. All pairs advance row by row
    together. The state holds distance minus place in the band: a step along the
    row then costs nothing and is a running minimum, a step down costs two. Once no
    pair can end within its one of ``limits``, those still open stay far apart.
    """
    n = np.array([len(x) for x in left])
    m = np.array([len(x) for x in right])
    far = np.int32(1 << 29)
    width, rows = 2 * band + 1, int(n.max(initial=0))
    a = np.zeros((len(left), rows + 1), np.uint32)
    # Column j of the second text is at place j + band; width places are seen at a time.
    b = np.zeros((len(left), max(rows, int(m.max(initial=0))) + 2 * width), np.uint32)
    for i, (x, y) in enumerate(zip(left, right)):
        a[i, : len(x)] = x
        b[i, band : band + len(y)] = y
    column = np.arange(width, dtype=np.int32) - band
    state = np.broadcast_to(np.where(column >= 0, np.int32(-band), far), (len(left), width)).astype(np.int32)
    out = np.full(len(left), far, np.int64)
    ending = np.argsort(n, kind="stable")
    ends = np.searchsorted(n[ending], np.arange(rows + 2))

    def record(row: int) -> None:
        done = ending[ends[row] : ends[row + 1]]
        place = m[done] - n[done] + band
        inside = (place >= 0) & (place < width)
        out[done[inside]] = state[done[inside], place[inside]] + place[inside]

    record(0)
    down = np.empty_like(state)
    for row in range(1, rows + 1):
        np.add(state[:, 1:], 2, out=down[:, :-1])
        state = state + (b[:, row - 1 : row - 1 + width] != a[:, row - 1 : row])
        np.minimum(state[:, :-1], down[:, :-1], out=state[:, :-1])
        np.minimum.accumulate(state, axis=1, out=state)
        if ends[row] < ends[row + 1]:
            record(row)
        if limits is not None and row % 64 == 0:
            # Costs never fall from row to row.
            if (((state + np.arange(width, dtype=np.int32)).min(axis=1) > limits) | (n <= row)).all():
                break
    return out


def _shared_words(x: np.ndarray, y: np.ndarray) -> int:
    """Words two texts have in common, repeats counted."""
    (a, n), (b, m) = (np.unique(t, return_counts=True) for t in (x, y))
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(n[at], m[to]).sum())


def similar(
    left: list[np.ndarray], right: list[np.ndarray], threshold: float, words_first: bool = False
) -> np.ndarray:
    """Whether each pair's edit similarity reaches the threshold.

    Bands widen until one proves a pair similar or holds every distance allowed. A pair that the first band leaves
    open goes when its words rule it out: all words that are not shared cost an edit. ``words_first`` asks that
    before the first band: for pairs of which few are similar.
    """
    longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
    shortest = np.array([min(len(x), len(y)) for x, y in zip(left, right)], np.int64)
    allowed = np.floor((1 - threshold) * longest + 1e-9).astype(np.int64)
    out = np.zeros(len(left), bool)
    todo = np.flatnonzero(longest - shortest <= allowed)

    def by_words(todo: np.ndarray) -> np.ndarray:
        shared = np.array([_shared_words(left[i], right[i]) for i in todo], np.int64)
        return todo[longest[todo] - shared <= allowed[todo]]

    if words_first:
        todo = by_words(todo)
    reach = FIRST_BAND
    while len(todo):
        todo = todo[np.argsort(longest[todo], kind="stable")]
        at = 0
        while at < len(todo):
            end, band = at, 1
            while end < len(todo) and end - at < SIDE_BY_SIDE and (end - at) * (2 * band + 1) <= CELLS:
                band = max(band, int(min(reach, allowed[todo[end]])))
                end += 1
            part = todo[at:end]
            out[part] = (
                banded_distances([left[i] for i in part], [right[i] for i in part], band, allowed[part]) <= allowed[part]
            )
            at = end
        todo = todo[~out[todo] & (allowed[todo] > reach)]
        if reach == FIRST_BAND and not words_first:
            todo = by_words(todo)
        reach *= 4
    return out


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                [np.frombuffer(w, np.uint32) for w in batch.column(c).to_pylist()] for c in ("words_a", "words_b")
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(similar(left, right, threshold))], ["a", "b", "ok"]
            )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [(word_hashes(t) >> np.uint64(32)).astype(np.uint32) for t in utf8(batch.column(1))]
        # Counts beyond 255 stay there: differences only shrink by it.
        counts = [np.bincount(w % BINS, minlength=BINS).clip(max=255).astype(np.uint8).tobytes() for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([w.tobytes() for w in words], pa.binary()),
                pa.array([len(w) for w in words], pa.int64()), pa.array(counts, pa.binary()),
            ],
            ["id", "words", "n", "bins"],
        )


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected (a, b) edges.

    Alternates two steps until nothing changes: every node hands the smallest
    of its neighbours to the larger ones, then to the smaller ones. The number of
    edges never grows, and path lengths shrink geometrically.
    """
    edges = staged(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        "component-edges",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = staged(large.where("u <> v").distinct(), "component-edges")
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        edges = staged(
            small.select("u", F.col("low").alias("v"))
            .unionByName(small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")))
            .distinct(),
            "component-edges",
        )
        # Done when every node has one edge and the nodes those lead to have none.
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("own"), F.lit(0).alias("root")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("own"), F.lit(1).alias("root"))
        )
        judged = ends.groupBy("node").agg(F.sum("own").alias("own"), F.max("root").alias("root"))
        if not judged.where((F.col("own") > 1) | ((F.col("own") > 0) & (F.col("root") > 0))).head(1):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _check(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ok) of (a, b) pairs, aligned."""
    one = words.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    two = words.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    aligned = pairs.join(one, "a").join(two, "b").select("a", "b", "words_a", "words_b").mapInArrow(
        _verify(threshold), "a long, b long, ok boolean"
    )
    return staged(aligned, "near-verified")


def _taking(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with what ``texts`` holds of their ``id``: a text is joined once, however many rows it has."""
    names = [c for c in rows.columns if c != "id"]
    each = rows.groupBy("id").agg(F.collect_list(F.struct(*names)).alias("rows")).join(texts, "id")
    return each.withColumn("row", F.explode("rows")).select("id", "row.*", *[c for c in texts.columns if c != "id"])


def _mixed(links: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with the buckets of their leader (as bits) that hold texts of another class than its own; others have no candidates."""
    leaders = texts.select(F.col("id").alias("leader"), F.col("known").alias("led"))
    members = links.join(texts, "id").join(leaders, "leader")
    foreign = members.where("known <> led").groupBy("leader").agg(
        F.bit_or("low").alias("mixed_low"), F.bit_or("high").alias("mixed_high"))
    return (
        members.join(foreign, "leader")
        .withColumns({c: F.col(c).bitwiseAND(F.col(f"mixed_{c}")) for c in ("low", "high")})
        .where("low <> 0 or high <> 0").drop("led", "mixed_low", "mixed_high")
    )


def _joining(links: DataFrame, known: DataFrame, words: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): similar pairs of members of one leader that join the classes so far, some joined by several."""
    classes = components(known.where("ok").select("a", "b"))
    # Texts whose lengths are in proportion stand in one length class or in neighbours.
    step = 1.001 * max(-math.log(max(threshold, 1e-6)), 1e-3)
    texts = words.select("id", "n").join(classes, "id", "left").select(
        "id", "n", F.coalesce("component", "id").alias("known"), F.floor(F.log("n") / step).alias("class"))
    members = (
        staged(_mixed(links, texts), "near-mixed")
        .select("*", F.explode(F.array("class", F.col("class") + 1)).alias("cell"))
        .withColumn("own", F.col("class") == F.col("cell")).drop("class")
    )
    cells = members.groupBy("leader", "cell").agg(
        F.count("*").alias("size"), F.sum("n").alias("words"), F.min(F.when(F.col("own"), F.col("n"))).alias("shortest"),
        F.min("known").alias("least"), F.max("known").alias("most"),
    ).where(F.col("shortest").isNotNull() & (F.col("least") < F.col("most")))
    blocks = F.ceil(F.greatest(F.col("size") / TOGETHER, F.col("words") / WORDS)).cast("int")
    # A text of the class below goes along if it is long enough for the shortest one here.
    enough = F.col("n") >= F.col("shortest") - F.floor((1 - threshold) * F.col("shortest") + 1e-9)
    dealt = (
        members.join(cells.select("leader", "cell", "shortest", blocks.alias("blocks")), ["leader", "cell"])
        .where(F.col("own") | enough).drop("n", "shortest")
    )
    met = (
        _taking(dealt, words.select("id", "n", "bins").join(reps, "id"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .drop("blocks", "other")
    )
    cell = ["leader", "cell", "lo", "hi"]
    # Only members that have candidates take their words along.
    found = staged(met.groupBy(*cell).applyInArrow(_open_members(threshold), _Cell.COLUMNS), "near-open")
    return _taking(found, words.join(reps, "id")).groupBy(*cell).applyInArrow(_join_classes(threshold), "a long, b long")


def _keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Id (NULL as the smallest) and text digest: what tells one document from another."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.unhex(F.md5(text))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Rows as (id, digest), and texts as (node, digest, rep, class_node, class_id).

    A node is the number of a text in the order of (rep, digest), where rep is the smallest id it has.
    """
    id_, digest = _keys(id_col, text_col)
    base = docs.select(id_.alias("id"), digest.alias("digest"), F.col(text_col).cast("string").alias("text"))
    sketched = staged(base.mapInArrow(_sketches, "id long, digest binary, sketch binary"), "near-sketches")
    standing = staged(
        ranked(
            sketched.groupBy("digest").agg(F.min("id").alias("rep")), [F.col("rep"), F.col("digest")], "node", "near-texts"
        ).select(F.col("node").cast("long").alias("node"), "digest", "rep"),
        "near-numbers",
    )
    own = standing.select("node", "digest", F.col("rep").alias("id"))
    reps = staged(
        sketched.where(F.col("sketch").isNotNull()).join(own, ["digest", "id"])
        .select(F.col("node").alias("id"), "sketch").dropDuplicates(["id"]),
        "near-representatives",
    )
    members = reps.mapInArrow(_buckets, "key long, id long, at int")
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last"))
    # Which of its buckets this leader leads, as bits.
    half = SKETCHES // 2
    low, high = (F.when(F.expr(f"at div {half} = {h}"), F.expr(f"shiftleft(1L, at % {half})")).otherwise(F.lit(0)) for h in (0, 1))
    links = staged(
        members.join(leaders.where("leader < last"), "key").where("id <> leader")
        .groupBy("leader", "id").agg(F.bit_or(low).alias("low"), F.bit_or(high).alias("high")),
        "near-links",
    )
    involved = links.select("id").unionByName(links.select(F.col("leader").alias("id"))).distinct()
    needed = own.join(involved.withColumnRenamed("id", "node"), "node")
    texts = base.join(needed, ["digest", "id"]).select(F.col("node").alias("id"), "text")
    # Rows of one id and text are one document; equal texts are represented by the smallest id.
    words = staged(
        texts.mapInArrow(_words, "id long, words binary, n long, bins binary").dropDuplicates(["id"]), "near-words"
    )
    known = _check(links.select(F.col("leader").alias("a"), F.col("id").alias("b")), words, threshold)
    joining = staged(_joining(links, known, words, reps, threshold), "near-joining")
    edges = known.where("ok").select("a", "b").unionByName(joining)
    grouped = components(edges).select(
        F.col("id").alias("node"), F.col("component").alias("class_node")
    )
    named = grouped.join(
        standing.select(F.col("node").alias("class_node"), F.col("rep").alias("class_id")), "class_node"
    )
    classes = standing.join(named, "node", "left").select(
        "node", "digest", "rep",
        F.coalesce("class_node", "node").alias("class_node"), F.coalesce("class_id", "rep").alias("class_id"),
    )
    return sketched.select("id", "digest"), classes


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8
) -> DataFrame:
    """(id, same_text_as, class_id) for every document: both are the smallest ids of their group."""
    rows, classes = _classes(docs, id_col, text_col, threshold)
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(classes, "digest").select(
        null_id("id").alias("id"), null_id("rep").alias("same_text_as"), null_id("class_id").alias("class_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """``docs`` without equal texts and near-duplicates of a smaller (id, digest)."""
    _, classes = _classes(docs, id_col, text_col, threshold)
    key, digest, row = (fresh(x) for x in ("id", "digest", "row"))
    kept = classes.where("node = class_node").select(F.col("rep").alias(key), F.col("digest").alias(digest))
    id_, text = _keys(id_col, text_col)
    matched = docs.withColumns({key: id_, digest: text}).join(kept, [key, digest], "left_semi")
    # Of rows with equal id and text the one whose other columns hash smallest, in every run.
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    tie = F.xxhash64(F.to_json(F.struct(*rest))) if rest else F.lit(0)
    picked = matched.groupBy(key, digest).agg(F.min_by(F.struct(*docs.columns), tie).alias(row))
    return picked.select(f"{row}.*")
