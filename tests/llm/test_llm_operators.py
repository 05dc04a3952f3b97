"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    chats, fingerprints, line_dedup, mixing, near_dedup, neighbours, packing, ppm, quality, sharding,
)
from millrace.llm.perfect_hash import PerfectHash
from millrace.llm.queries import VOCABULARY
from millrace.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, line string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with working ones."""
    return spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], DOCS
    )


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs, empty and long texts, repeated rows."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(1, None, "a"), (2, "", None), (3, "one", "b"), (None, "A null id speaks here", "a"), (5, " \n\n ", "b")]
    rows += [(10 + i, say(rng.randint(1, 400)) + "\nThis very line is found in many documents.", "abc"[i % 3]) for i in range(60)]
    rows += [(90, say(60_000), "a"), (91, say(30) + "<|endoftext|>" + say(5), "c")]
    rows += [(92, "Same row", "a"), (92, "Same row", "a")]
    return rows


# -- line dedup ------------------------------------------------------------------------


def brute_lines(rows, min_docs=3, min_chars=20):
    def key(line):
        line = line.strip(" \t\n\v\f\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    where = defaultdict(list)
    for i, text, _ in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                where[k].append(-math.inf if i is None else i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        own = -math.inf if i is None else i
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark, awkward):
    frame = line_dedup.drop_repeated_lines(docs_of(spark, awkward))
    assert {"size", "id", "line", "lang"} <= set(frame.columns)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in frame.collect()), key=repr)
    assert got == brute_lines(awkward)
    assert sum(r[2] for r in got) > 50
    assert line_dedup.drop_repeated_lines(docs_of(spark, awkward).limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 63, (2, 50_000), dtype=np.uint64)
    packed = PerfectHash.build(high, low).pack()
    hashed = PerfectHash.unpack(packed)
    assert sorted(hashed.index(high, low)) == list(range(50_000))
    assert len(packed) * 8 < 5 * 50_000
    assert len(PerfectHash.build(high[:0], low[:0]).index(high, low)) == 50_000


# -- near duplicates -------------------------------------------------------------------


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact_inside_the_band():
    rng = random.Random(3)
    pairs = []
    for _ in range(120):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = [rng.randint(0, 3)] if rng.random() < 0.7 else []
        pairs.append((a, b or [1]))
    left, right = ([np.array(p[i], np.uint32) for p in pairs] for i in (0, 1))
    got = near_dedup.banded_distances(left, right, 12)
    want = [brute_distance(a, b) for a, b in pairs]
    assert all(g == w for g, w in zip(got, want) if w <= 12)
    assert all(g >= w for g, w in zip(got, want))
    flags = near_dedup.similar(left, right, 0.8)
    assert list(flags) == [w <= 0.2 * max(len(a), len(b)) + 1e-9 for w, (a, b) in zip(want, pairs)]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(60, 300))]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    # Clean documents that share a passage must stay apart.
    texts += [passage + [word() for _ in range(rng.randint(60, 120))] for _ in range(40)]
    rows = [(i, " ".join(t), "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", "s"), (902, "  ", "s")]
    got = {r.id: r.class_id for r in near_dedup.near_duplicate_classes(docs_of(spark, rows)).collect()}
    parent = {i: i for i, _, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i], texts[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(set(a) & set(b)) > 30:
                if brute_distance(a, b) <= 0.2 * max(len(a), len(b)):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i: root(i) for i in range(len(texts))} | {900: 900, 901: 900, 902: 902}
    assert got == want
    assert len(set(got.values())) < len(rows) - 30


def test_near_duplicates_awkward(spark, awkward):
    frame = near_dedup.near_duplicate_classes(docs_of(spark, awkward))
    assert frame.count() == len(awkward)
    kept = near_dedup.keep_one(docs_of(spark, awkward))
    assert kept.columns == docs_of(spark, awkward).columns
    assert Counter(r.doc_id for r in kept.collect())[92] == 1
    assert near_dedup.near_duplicate_classes(docs_of(spark, awkward).limit(0)).count() == 0


def test_near_duplicates_keep_texts_that_share_an_id(spark):
    rng = random.Random(21)
    say = lambda: [f"{rng.choice('abcdefgh')}{rng.randint(0, 9999)}" for _ in range(80)]
    texts = [say() for _ in range(12)]
    near = [*texts[0][:-1], "end"]
    rows = [(None if i % 2 else 7, " ".join(t), "s") for i, t in enumerate(texts)]
    rows += [(7, " ".join(near), "s"), (9, " ".join(texts[3]), "s"), (7, " ".join(texts[2]), "s")]
    want = Counter(" ".join(t) for t in texts)
    for _ in range(2):
        rng.shuffle(rows)
        kept = near_dedup.keep_one(docs_of(spark, rows)).collect()
        got = Counter(r.text for r in kept)
        first = min((" ".join(texts[0]), " ".join(near)), key=lambda t: hashlib.md5(t.encode()).digest())
        assert got == want - Counter([" ".join(texts[0])]) + Counter([first])
        assert {r.doc_id for r in kept if r.text == " ".join(texts[3])} == {None}
    frame = near_dedup.near_duplicate_classes(docs_of(spark, rows))
    assert Counter(r.id for r in frame.collect()) == Counter(i for i, _, _ in rows)


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, 2000)]
    random.Random(1).shuffle(path)
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[2000] == 1000


# -- nearest neighbours ----------------------------------------------------------------


def brute_nearest(ids, vectors, k):
    out = {}
    for i, q in zip(ids, vectors):
        if i % 20 == 0:
            ranked = sorted(((-float(np.dot(q, v)), j) for j, v in zip(ids, vectors) if j != i))
            out[i] = ranked[:k]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(0, 12, 6000)] + 0.4 * rng.normal(size=(6000, 24))).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None] * rng.choice([1, 0.7], 6000)[:, None]
    vectors[0] /= np.linalg.norm(vectors[0])
    vectors[0] *= 2  # the longest vector is its own nearest
    vectors[1000:3000] = vectors[0]  # a third are copies of one
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(7000, None, "x"), (7020, [0.0] * 24, "x"), (7040, [float("nan")] * 24, "x"), (7060, [1.0] * 3, "x"), (None, vectors[5].tolist(), "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, point string")
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute_nearest(list(range(6000)), vectors.astype(np.float64), 20)
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert [i for i, _ in got[1020]] == [0, *range(1000, 1019)]  # ties go to the smaller id


def test_neighbours_small_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 2.0])], schema)
    got = [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, -1.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(few.where("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_hilbert_steps_to_a_neighbouring_cell():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = neighbours.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    ordered = cells[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


# -- quality ---------------------------------------------------------------------------


def test_quality_held_out(spark, rows):
    rng = random.Random(9)
    good = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(300)]
    data, labels = [], []
    for i in range(400):
        words = [rng.choice(good) for _ in range(rng.randint(5, 120))]
        label = int(rng.random() < 0.8)
        if not label:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w for w in words for _ in range(6)]
        data.append((i, " ".join(words), "s"))
        labels.append((i, label))
    labels += [(5000, 1), (None, 0), (7, None)]
    data += [(990, None, "s"), (991, "", "s")]
    docs = docs_of(spark, data)
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"), quality.remainder("doc_id", 4) != 2)
    got = {r.doc_id: r.score for r in quality.score(docs, model, score_col="size").withColumnRenamed("size", "score").collect()}
    held = [(i, y) for i, y in labels if i is not None and y is not None and i < 400 and zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= quality.KEEP) == bool(y) for i, y in held)
    assert len(held) > 50 and right >= 0.97 * len(held)
    assert got[990] == got[991] and 0 <= got[990] <= 1


def test_quality_without_labels(spark, awkward):
    docs = docs_of(spark, awkward)
    none = spark.createDataFrame([], "doc_id long, quality int")
    for labels, want in ((none, 0.5), (spark.createDataFrame([(10, 1)], "doc_id long, quality int"), 0.999)):
        model = quality.train(docs, labels, F.lit(True))
        assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {want}
    assert quality.score(docs.limit(0), model).count() == 0


def test_features_of_blocks_cover_the_text():
    text = ("wörd " * 400_000).encode()
    assert sum(len(f) for f in quality.blocks(text)) > 2 * len(text) - 100


# -- fingerprints ----------------------------------------------------------------------


def test_fingerprints_edit_and_likeness(spark, awkward):
    got = fingerprints.compare_with_edited(docs_of(spark, awkward)).select(
        "*", fingerprints.as_text(F.col("print")).alias("p"), fingerprints.as_text(F.col("edited_print")).alias("e"),
        fingerprints.likeness(F.col("print"), F.col("edited_print")).alias("near"),
    ).collect()
    assert len(got) == len(awkward)
    order = sorted(((i, t or "") for i, t, _ in awkward), key=lambda x: -math.inf if x[0] is None else x[0], reverse=True)
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want[i, t[: len(t) - half] + after[:half], len(t)] += 1
    assert Counter((r.id, r.edited, r.n_chars) for r in got) == want
    by_text = defaultdict(set)
    texts = {i: t or "" for i, t, _ in awkward}
    for r in got:
        by_text[texts[r.id]].add(r.p)
        assert 0 <= r.near <= 1 and (r.edited != texts[r.id] or (r.near == 1 and r.p == r.e))
    assert all(len(p) == 1 for p in by_text.values())
    long = next(r for r in got if r.id == 90)
    assert 0.45 < long.near < 0.55  # the next text is short: half of the text is what the union is more


def test_fingerprints_merge_and_contain(spark):
    words = [f"w{i}" for i in range(6000)]
    part, whole = " ".join(words[:300]), " ".join(words)
    row = spark.createDataFrame([(part, whole, "a b c", "")], "part string, whole string, tiny string, none string").select(
        *(fingerprints.fingerprint(F.col(c)).alias(c) for c in ("part", "whole", "tiny", "none"))
    ).select(
        fingerprints.containment(F.col("part"), F.col("whole")), fingerprints.likeness(F.col("part"), F.col("whole")),
        fingerprints.as_text(fingerprints.merged(F.col("part"), F.col("whole"))) == fingerprints.as_text(F.col("whole")),
        F.size("tiny.hashes"), F.size("none.hashes"), fingerprints.likeness(F.col("none"), F.col("tiny")),
        F.size("whole.hashes"),
    ).first()
    assert row[0] == 1.0 and row[1] < 0.1 and row[2] is True and row[3] == 1 and row[4] == 0 and row[5] == 0.0
    assert 600 < row[6] < 900  # an eighth of 5996


def test_fingerprints_of_repeated_lines(spark):
    rows = [(f"line {i} says {i} again and again\n" * 60, f"word{i} " * 300) for i in range(60)]
    prints = spark.createDataFrame(rows, "line string, word string").withColumn("none", F.lit("")).select(
        *(fingerprints.fingerprint(F.col(c)).alias(c) for c in ("line", "word", "none"))
    )
    sizes = prints.select(F.size("line.hashes"), F.size("word.hashes"), "line.scale", "word.scale").distinct().collect()
    assert [tuple(r) for r in sizes] == [(7, 1, 1, 1)]
    for f in (fingerprints.likeness, fingerprints.containment):
        for a, b, want in (("line", "word", 0.0), ("word", "none", 0.0), ("none", "line", 0.0), ("line", "line", 1.0), ("none", "none", 1.0)):
            assert {r[0] for r in prints.select(f(F.col(a), F.col(b))).collect()} == {want}


def test_fingerprints_with_nothing_left_to_compare(spark):
    big = " ".join(f"w{i}" for i in range(6000))
    parts = [(" ".join(f"w{j}" for j in range(i, i + 5)), big) for i in range(0, 400, 10)]
    got = spark.createDataFrame(parts, "part string, whole string").select(
        *(fingerprints.fingerprint(F.col(c)).alias(c) for c in ("part", "whole"))
    ).select(fingerprints.containment(F.col("part"), F.col("whole"))).collect()
    # A part of one shingle is in the whole or cannot be judged, never out of it.
    assert {r[0] for r in got} == {None, 1.0}
    left = F.struct(F.lit(8).alias("scale"), F.array().cast("array<long>").alias("hashes"))
    assert spark.range(1).select(fingerprints.likeness(left, left)).first()[0] is None


# -- packing ---------------------------------------------------------------------------


def test_encoder_agrees_with_the_tokenizer():
    both, plain = Encoder(*VOCABULARY), Encoder(VOCABULARY[0])
    rng = random.Random(4)
    kinds = [" ", "  ", "\n", " \n", "\t", "a", "Zé", "ß", "1", "²", "'s", "'", ".", "!!", "<|endoftext|>", "日本", "🙂", " ", " ", "क"]
    for _ in range(3000):
        text = "".join(rng.choice(kinds) for _ in range(rng.randint(0, 12)))
        assert both.encode(text) == plain.encode(text), repr(text)


def check_pieces(rows, texts, end=1):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY[0])
    want = Counter()
    for i, text, _ in texts:
        want[i, np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4").tobytes()] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at == 2048 or at & (at - 1) == 0
    for i, pieces in by_doc.items():
        if sum(n for (j, _), n in want.items() if j == i) == 1:
            pieces.sort(key=lambda r: r.start)
            assert want[i, b"".join(bytes(r.ids) for r in pieces)] == 1
            assert all(r.start == sum(p.length for p in pieces[:n]) and r.doc_tokens * 4 == sum(len(p.ids) for p in pieces) for n, r in enumerate(pieces))
    assert sum(r.length for r in rows) == sum(len(ids) // 4 * n for (_, ids), n in want.items())


def test_packing(spark, awkward):
    rows = packing.pack_documents(docs_of(spark, awkward), *VOCABULARY).collect()
    check_pieces(rows, awkward)
    again = packing.pack_documents(docs_of(spark, awkward), *VOCABULARY).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert packing.pack_documents(docs_of(spark, awkward).limit(0), *VOCABULARY).count() == 0


def test_packing_brings_related_texts_together(spark):
    rng = random.Random(8)
    topics = [[f"{c}{rng.randint(100, 999)}" for _ in range(40)] for c in "abcd"]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(90)), "s") for i in range(200)]
    pieces = packing.pack_documents(docs_of(spark, rows).coalesce(1), *VOCABULARY).collect()
    by_sequence = defaultdict(Counter)
    for r in pieces:
        by_sequence[r.sequence_id][r.doc_id % 4] += r.length
    same = sum(max(c.values()) for c in by_sequence.values())
    assert same > 0.6 * sum(sum(c.values()) for c in by_sequence.values())  # a quarter by chance


# -- sharding --------------------------------------------------------------------------


def test_sharding_is_exact_and_reruns_agree(spark, awkward):
    docs = docs_of(spark, awkward + [(1000 + i, "t", "a") for i in range(5000)])
    rows = sharding.shuffle_into_shards(docs).collect()
    sizes = Counter(r.shard for r in rows)
    assert sum(sizes.values()) == docs.count() and set(sizes) == set(range(16))
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sizes[shard]))
    place = {r.doc_id: (r.shard, r.slot) for r in rows if r.doc_id and r.doc_id >= 1000}
    assert place == {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs.repartition(3)).collect() if r.doc_id and r.doc_id >= 1000}
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0
    # Neighbours by id are as often in one shard as by chance, and slots do not follow ids.
    together = sum(place[i][0] == place[i + 1][0] for i in range(1000, 5999))
    assert 0.03 < together / 4999 < 0.1
    assert abs(np.corrcoef([i for i in place], [s for _, s in place.values()])[0, 1]) < 0.06


def test_communication_matrix_sums_and_spread():
    blocks = [500, 0, 3, 1200, 77]
    cells = []
    for seed in range(300):
        matrix = sharding.communication_matrix(blocks, 7, seed)
        assert [sum(r) for r in matrix] == blocks
        columns = [sum(c) for c in zip(*matrix)]
        assert max(columns) - min(columns) <= 1
        cells.append(matrix[0][3])
    total, n, k = sum(blocks), 500, sum(blocks) // 7
    mean, variance = n * k / total, n * (k / total) * (1 - k / total) * (total - n) / (total - 1)
    assert abs(np.mean(cells) - mean) < 4 * math.sqrt(variance / 300)
    assert 0.7 < np.var(cells) / variance < 1.35


# -- mixing ----------------------------------------------------------------------------


def brute_targets(totals):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, open_, out = 1.5 * sum(totals.values()), set(order), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * totals[s]}
        if not over:
            return out | {s: weight[s] * level for s in open_}
        for s in over:
            out[s] = 2.0 * totals[s]
            budget -= out[s]
        open_ -= over
    return out


def test_mixing_targets_and_copies(spark, awkward):
    rng = random.Random(6)
    rows = awkward + [(2000 + i, "w " * rng.randint(0, 9), rng.choice(["hot"] * 5 + ["b", "z", None])) for i in range(4000)]
    got = mixing.mix_sources(docs_of(spark, rows), size_col="n_words").collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s in rows:
        totals[s] += size(t)
    want = brute_targets(dict(totals))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.n_words
        largest[r.source] = max(largest[r.source], r.n_words)
    for s in want:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6, s
    assert mixing.mix_sources(docs_of(spark, rows).limit(0)).count() == 0


# -- language model --------------------------------------------------------------------


def test_ppm_base_scores_and_model(spark, awkward):
    rng = random.Random(12)
    words = ["".join(rng.choice("aeioTNRS") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    rows = awkward + [(3000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "s") for i in range(300)]
    got = ppm.score_documents(docs_of(spark, rows), quality.remainder("doc_id", 5) != 1).collect()
    assert len(got) == len(rows)
    tokens = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    trained = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    counts = Counter()
    for i, t, _ in rows:
        if trained(i):
            counts.update([*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t, _ in rows:
        own = [*tokens(t), "\n"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[i, not trained(i), len(own), sum(counts[w] > 0 for w in own), n, round(base, 6)] += 1
    assert Counter((r.id, not r.trained_on, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if not r.trained_on and r.id and r.id >= 3000]
    assert sum(r.score for r in held) > sum(-(r.n_tokens) * 6 for r in held)
    assert all(r.score < 0 for r in got)


def ppm_by_hand(training, texts):
    """Log10 probability of each text: contexts of up to six bytes, longest first, seen symbols excluded on escape."""
    follow = {}
    bytes_of = lambda t: b"\n" * ppm.ORDER + b" ".join(ppm.tokens((t or "").encode())) + ppm.END
    for t in training:
        data = bytes_of(t)
        for i in range(ppm.ORDER, len(data)):
            for k in range(ppm.ORDER + 1):
                follow.setdefault(data[i - k : i], Counter())[data[i]] += 1

    def probability(context, symbol):
        seen = follow.get(context)
        shorter = (lambda s: probability(context[1:], s)) if context else (lambda s: 1 / 256)
        if not seen:
            return shorter(symbol)
        total = sum(seen.values())
        if symbol in seen:
            return (seen[symbol] - 0.5) / total
        return len(seen) / (2 * total) / (1 - sum(map(shorter, seen))) * shorter(symbol)

    out = []
    for t in texts:
        data = bytes_of(t)
        out.append(sum(math.log10(probability(data[i - ppm.ORDER : i], data[i])) for i in range(ppm.ORDER, len(data))))
    return out


@pytest.mark.parametrize("hot", [0, 7, 1 << 21])
def test_ppm_scores_with_every_counted_gram(spark, awkward, monkeypatch, hot):
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeXYé中") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    short = [r for r in awkward if len(r[1] or "") < 5_000]
    rows = short + [(4000 + i, " ".join(rng.choice(words[: 25 if i % 5 else 40]) for _ in range(rng.randint(1, 30))), "s") for i in range(60)]
    trained = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    want = ppm_by_hand([t for i, t, _ in rows if trained(i)], [t for _, t, _ in rows])
    got = ppm.score_documents(docs_of(spark, rows), quality.remainder("doc_id", 5) != 1).collect()
    assert Counter((r.id, round(r.score, 4)) for r in got) == Counter((r[0], round(w, 4)) for r, w in zip(rows, want))


def test_ppm_equal_texts_have_equal_scores(spark, monkeypatch):
    monkeypatch.setattr(ppm, "HOT_GRAMS", 20)
    monkeypatch.setattr(ppm, "HOT", 3)
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(30)) for _ in range(12)]
    rows = [(i, texts[i % 12], "s") for i in range(240)]
    got = ppm.score_documents(docs_of(spark, rows).repartition(5), F.col("doc_id") % 3 != 0).collect()
    assert len({(r.id % 12, r.base_score, r.score) for r in got}) == 12


def test_ppm_is_a_distribution(spark):
    rng = np.random.default_rng(3)
    text = bytes(rng.choice(list(b"abcde "), 3000).tolist()).decode()
    levels = ppm.train_trie(spark.createDataFrame([(text,)], "text string"))
    for context in (b"eabcde", b"zzzzzz", b"\n\n\n\n\n\n", b"e abca"):
        codes = [(int.from_bytes(context + bytes([s]), "big"),) for s in range(256)]
        asked = spark.createDataFrame(codes, "code long")
        seen = asked.join(levels[-1], "code").select("code", F.log10((F.col("n") - 0.5) / F.col("total")).alias("value"))
        for more in ppm.unseen_values(asked.join(levels[-1], "code", "left_anti"), levels):
            seen = seen.unionByName(more)
        values = [r.value for r in seen.collect()]
        assert len(values) == 256 and sum(10**v for v in values) == pytest.approx(1, abs=1e-9)


def test_ppm_without_training(spark, awkward):
    got = ppm.score_documents(docs_of(spark, awkward), F.lit(False)).collect()
    assert len(got) == len(awkward) and {r.n_known for r in got} == {0}
    empty = next(r for r in got if r.id == 1)
    assert empty.score == pytest.approx(-math.log10(256), abs=1e-5)
    assert ppm.score_documents(docs_of(spark, awkward).limit(0), F.lit(True)).count() == 0


# -- chats -----------------------------------------------------------------------------


def test_chats_link_order_and_validate(spark):
    call = lambda i, **a: '{"tool_calls": [{"name": "add", "id": "%s", "arguments": %s}]}' % (i, str(a.pop("raw", None) or a).replace("'", '"'))
    rows = [
        (1, 0, "user", 'say "hi"\n'), (1, 2, "assistant", call("x", b=2, a=1)),
        (1, 1, "tool", '{"tool_call_id": "x", "content": "early"}'), (1, 3, "tool", '{"tool_call_id": "x", "content": "again"}'),
        (1, 4, "assistant", call("y", a="one")), (1, 300, "assistant", call("z", raw="[1]")),
        (1, 5, "tool", "not json"), (2, 0, None, None), (2, 0, None, None), (None, None, "user", "lost"),
        (3, 0, "assistant", '{"tool_calls": "none"'), (3, 1, "assistant", '{"tool_calls":[{"id":"q","name":"other","arguments":{}}]}'),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    schema = {"add": {"a": ("integer", True), "b": ("number", False)}}
    got = {(r.conv_id, r.part): r for r in chats.format_chats(frame, schema).collect()}
    one = got[1, 0]
    assert (one.n_messages, one.n_calls, one.n_linked, one.n_orphans) == (6, 2, 1, 2)
    assert one.chat == (
        '[{"content":"say \\"hi\\"\\n","role":"user"},'
        '{"role":"assistant","tool_calls":[{"arguments":{"a":1,"b":2},"id":"x","name":"add"}]},'
        '{"content":"early","role":"tool","tool_call_id":"x"},{"content":"again","role":"tool","tool_call_id":"x"},'
        '{"role":"assistant","tool_calls":[{"arguments":{"a":"one"},"id":"y","name":"add"}]},'
        '{"content":"not json","role":"tool"}]'
    )
    assert one.n_errors == 1 and got[1, 1].n_errors == 1 and got[3, 0].n_errors == 1
    assert got[2, 0].n_messages == 1 and got[None, None].chat == '[{"content":"lost","role":"user"}]'
    assert chats.format_chats(frame.limit(0), schema).count() == 0


def test_chats_keep_content_fields_and_invalid_arguments(spark):
    rows = [
        (1, 0, "assistant", '{"content": "Let me see", "mood": {"b": 1, "a": null}, "tool_calls": [{"type": "function", "id": "x", "name": "add", "arguments": "a = 1"}]}'),
        (1, 1, "tool", '{"tool_call_id": "x", "content": "3", "is_error": false, "role": "tool"}'),
        (1, 2, "assistant", '{"role": "bot", "tool_calls": [], "content": [{"text": "hi"}]}'),
        (1, 3, "assistant", '{"tool_calls": [{"id": "y", "name": "add", "arguments": "{\\"a\\": 1}"}], "content": "one", "content": "two"}'),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chats.format_chats(frame, {"add": {"a": ("integer", True)}}).first()
    assert json.loads(got.chat) == [
        {"content": "Let me see", "mood": {"a": None, "b": 1}, "role": "assistant",
         "tool_calls": [{"arguments": "a = 1", "id": "x", "name": "add", "type": "function"}]},
        {"content": "3", "is_error": False, "role": "tool", "tool_call_id": "x"},
        {"content": [{"text": "hi"}], "role": "assistant", "role_in_text": "bot", "tool_calls": []},
        {"content": rows[3][3], "role": "assistant"},
    ]
    assert got.chat.startswith('[{"content":"Let me see","mood":{"a":null,"b":1},"role":"assistant","tool_calls":[{"arguments":"a = 1",')
    assert got.errors == ["arguments are no object"] and got.n_linked == 1


def test_chats_name_the_errors(spark):
    rows = [('{"a": 1.5, "c": true}',), ('{"b": "x"}',), ('{"a": 3}',), ("nonsense",), (None,)]
    schema = {"add": {"a": ("integer", True), "b": ("number", False)}}
    got = [sorted(r[0]) for r in spark.createDataFrame(rows, "j string").select(chats.argument_errors(F.lit("add"), F.col("j"), schema)).collect()]
    assert got == [["a is no integer", "unexpected c"], ["b is no number", "missing a"], [], ["arguments are no object"], ["arguments are no object"]]
