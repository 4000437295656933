"""Resampling, nearest neighbours and centroids: awkward rows, and brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import graphsearch, resample, zonemaps

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, score string, rank int, _row long, n_words string"
LONG = " ".join(f"wort{i % 5003} der Ää{i % 7}" for i in range(30_000))
TEXTS = [
    (1, "The cat sat on the mat, THE CAT sat on the mat. " * 10),
    (1, "The cat sat on the mat, THE CAT sat on the mat. " * 10),
    (1, "one of another text " * 30),
    (2, None),
    (3, ""),
    (4, " \t.\n--"),
    (None, "lonely words " * 40),
    (None, "lonely words " * 40),
    (5, LONG),
    (6, "日本語 🎉é x y " + "z" * 5000 + " end " * 25),
    (7, "exactly nineteen " * 9 + "w"),
    *[(100 + i, f"shared phrase number {i % 4} " * (5 + i % 9)) for i in range(80)],
]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def features(text):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def buckets(text):
    return Counter(zlib.crc32(f.encode()) % 10_000 for f in features(text))


def expected_rows(rows, target):
    corpus, wanted = Counter(), Counter()
    for _, text in rows:
        corpus += buckets(text)
    for text in target:
        wanted += buckets(text)
    s, t = sum(corpus.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    out = []
    for doc_id, text in rows:
        weight = sum(gain[b] * n for b, n in buckets(text).items())
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(WORD.findall(lower(text or ""))), len(features(text)), weight, score, None])
    drawable = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, row in enumerate(drawable[: 5 * len(drawable) // 100], 1):
        row[5] = place
    return sorted(map(tuple, out), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 3, 9, "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("head", [{}, {"head_words": 3, "head_pairs": 2}, {"head_words": 0, "head_pairs": 0}])
def test_resample_equals_brute_force(spark, monkeypatch, head):
    """Whatever the head holds, buckets are exact; slices do not lose the runs at their edges."""
    target = ["the cat sat", "shared phrase", None, "", "Wort der"]
    docs, wanted = documents(spark, TEXTS).repartition(3), spark.createDataFrame([(t,) for t in target], "text string")
    settings = replace(resample.Settings(), **head)
    made = resample.resample(docs, wanted, settings).collect()
    assert sorted(map(tuple, made), key=repr) == expected_rows(TEXTS, target)


def test_slices_of_a_long_text(monkeypatch):
    import pyarrow as pa

    column = pa.array(["a b c d", None, "e", LONG[:5000]])
    whole = {}
    for size in (1 << 19, 7):
        monkeypatch.setattr(resample, "SLICE", size)
        head = resample.Head([b"a", b"b", b"der"], [(b"a", b"b")], 40)
        found = Counter()
        for first, _, slices in resample.words_of(column):
            for part in slices:
                held = {}
                for length in (1, 2, 3):
                    firsts, crcs = head.crcs(part, length, held)
                    found.update(zip((part.rows[firsts] + first).tolist(), crcs.tolist()))
        whole[size] = found
    expected = Counter((row, zlib.crc32(f.encode())) for row, text in enumerate(column.to_pylist()) for f in features(text))
    assert whole[7] == whole[1 << 19] == expected


def test_resample_draws_without_scarce_rows(spark):
    """Ties of score go to the smaller id, and a table without enough words draws nothing."""
    few = spark.createDataFrame([(i, "short text") for i in range(50)], "doc_id long, text string")
    rows = resample.resample(few, few).collect()
    assert len(rows) == 50 and all(r["rank"] is None for r in rows)


# --- Vectors -----------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label string, node long, place string"
BAD = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [None] + [1.0] * 63]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], VECTORS)


def random_rows(n, seed=1, scale=0.3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(n, 64)) * scale)]


def nearest(rows, queries, top=20):
    usable = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    pairs = set((i, tuple(v)) for i, v in usable)
    out = {}
    for i, q in pairs:
        if queries(i):
            scored = sorted((-float(sum(a * b for a, b in zip(q, v))), j) for j, v in pairs if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scored[:top]]
    return out


def test_nearest_by_brute_force_with_copies_and_unlike_norms(spark):
    """Inner products favour long vectors; copies share scores and go by id; bad vectors take no part."""
    rows = random_rows(300)
    rows = [(i, [float(np.float32(x * (1 + i % 5))) for x in v]) for i, v in rows]
    rows += [(1000 + i, rows[7][1]) for i in range(120)] + [(2000 + i, v) for i, v in enumerate(BAD)]
    rows += [(None, rows[3][1]), (3000, rows[5][1]), (3000, rows[5][1]), (4000, [1.0, 2.0]), (4020, [3.0, 4.0])]
    table = vectors(spark, rows).repartition(3)
    found = {}
    for r in graphsearch.search(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        assert r["recall"] >= 0.92
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = nearest(rows, lambda i: i % 20 == 0)
    expected = {q: near for q, near in expected.items() if near}
    assert set(found) == set(expected)
    hits = sum(len({j for j, _ in found[q]} & {j for j, _ in near}) for q, near in expected.items())
    assert hits >= 0.98 * sum(map(len, expected.values()))
    for q, near in found.items():
        assert len(near) == len(expected[q])
        exact = dict(expected[q])
        assert all(math.isclose(s, exact[j], rel_tol=1e-12, abs_tol=1e-12) for j, s in near if j in exact)
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
    assert [j for j, _ in found[1000][:20] if 1000 < j < 2000] == [1000 + i for i in range(1, 21)][: len([j for j, _ in found[1000] if 1000 < j < 2000])]


def test_few_and_no_vectors(spark):
    rows = random_rows(9)
    table = vectors(spark, rows)
    found = graphsearch.search(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [j for j, _ in nearest(rows, lambda i: i == 0)[0]] and len(found) == 8
    assert graphsearch.search(table.limit(0), table).count() == 0
    assert graphsearch.search(table, table.limit(0)).count() == 0
    assert graphsearch.search(vectors(spark, list(enumerate(BAD))), table).count() == 0


def test_queries_from_outside(spark):
    rows, others = random_rows(400, scale=0.2), [(10_000 + i, v) for i, v in random_rows(30, seed=5)]
    found = graphsearch.search(vectors(spark, rows), vectors(spark, others)).collect()
    true = {i: {j for _, j in sorted((-float(np.dot(q, v)), j) for j, v in rows)[:20]} for i, q in others}
    assert sum(r["vec_id"] in true[r["query_id"]] for r in found) >= 0.92 * 600 and len(found) == 600


def lloyd(rows, clusters=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest())
    centroids = [v for _, v in order[:clusters]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        where = [n for _, n in assigned()]
        for n in range(len(centroids)):
            of = [v for (_, v), w in zip(kept, where) if w == n]
            if of:
                centroids[n] = [sum(x) // len(of) for x in zip(*of)]
    final = assigned()
    total, each = sum(d for d, _ in final), Counter()
    for d, n in final:
        each[n] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, each[n], total, name[n]) for (i, _), (d, n) in zip(kept, final)), key=repr)


def test_centroids_equal_brute_force(spark):
    rows = random_rows(150, scale=0.1) + [(i + 500, [float(np.float32(x + (i % 3))) for x in v]) for i, v in random_rows(200, 2, 0.02)]
    rows += [(900 + i, rows[4][1]) for i in range(60)] + [(None, rows[9][1])] * 2 + [(2000 + i, v) for i, v in enumerate(BAD)] + [(3000, [1.0] * 63)]
    made = zonemaps.cluster(vectors(spark, rows).repartition(3), replace(zonemaps.Settings(), block=16)).collect()
    assert sorted(map(tuple, made), key=repr) == lloyd(rows)


def test_few_equal_and_no_vectors_to_cluster(spark):
    rows = [(i, [0.5] * 64) for i in range(5)] + [(9, [-0.25] * 64)]
    made = zonemaps.cluster(vectors(spark, rows)).collect()
    assert sorted(map(tuple, made), key=repr) == lloyd(rows)
    assert zonemaps.cluster(vectors(spark, list(enumerate(BAD[:2])))).count() == 0


def test_large_components(spark):
    """Exact beyond what doubles can add, and a clear failure beyond a long."""
    rows = [(i, [float(np.float32(x * 1e5)) for x in v]) for i, v in random_rows(40)]
    assert sorted(map(tuple, zonemaps.cluster(vectors(spark, rows)).collect()), key=repr) == lloyd(rows)
    with pytest.raises(Exception, match="may exceed a long"):
        zonemaps.cluster(vectors(spark, [(1, [1e30] * 64)])).count()


def test_hilbert_curve_takes_single_steps():
    for axes, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes), axis=-1).reshape(-1, axes)
        keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_keep_every_nearest_centroid():
    rng = np.random.default_rng(3)
    for _ in range(50):
        x = rng.integers(-500, 500, (40, 64)) // 4 + rng.integers(-200, 200, 64)
        centroids = rng.integers(-300, 300, (8, 64))
        centroids[1] = centroids[0]
        possible = zonemaps.candidates(x.min(axis=0)[None], x.max(axis=0)[None], centroids)[0]
        which, _ = zonemaps.nearest(x, centroids)
        assert possible[which].all() and possible[1] == possible[0]


def test_zone_maps_spare_distances(spark):
    """On vectors in a few tight groups, most need no distance."""
    rows = [(i, [float(np.float32(x + 2 * (i % 8 == a % 8))) for a, x in enumerate(v)]) for i, v in random_rows(2000, scale=0.01)]
    settings = zonemaps.Settings()
    stored = zonemaps.whole(vectors(spark, rows), settings, "vec_id", "embedding")
    zones = zonemaps.zone_blocks(stored, settings)
    centroids = zonemaps.first_centroids(stored, settings)
    for _ in range(3):
        centroids, share = zonemaps.moved(zones, centroids, settings)
    assert share > 0.5


# --- Changes to earlier operators ------------------------------------------------------------------


def test_training_positions_are_the_order_of_due_times(spark):
    from tallyframe.llm import mixing

    rows = [(i if i % 9 else None, f"w{i} " * (1 + i % 13), "abc"[i % 3] if i % 5 else None) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = []
    for r in mixing.training_positions(mixing.mix(docs)).collect():
        for part, place in zip(r["parts"], r["positions"]):
            assert (part is None) == (place is None)
            if part is not None:
                taken.append((place, part["due"]))
    assert [p for p, _ in sorted(taken)] == list(range(len(taken)))
    assert [d for _, d in sorted(taken)] == sorted(d for _, d in taken)


def test_quality_changes_little_with_one_more_document(spark):
    """No number of documents switches the judgement on: junk is judged among 3, 19 and 20 alike."""
    from tallyframe.llm import quality

    made = np.random.default_rng(8)
    nouns = ["cat", "dog", "house", "town", "river", "bread", "letter", "garden", "winter", "story", "table", "friend"]
    linked = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "by"]

    def clean():
        return ", ".join(" ".join([*made.choice(linked, 2), made.choice(nouns) + "s" * int(made.integers(2)), made.choice(linked)]) for _ in range(90))

    junk = " ".join(f"qx{i}zz" for i in range(300))
    seen = []
    for n in (3, 19, 20):
        rows = [(i, clean(), "en", "s", 0) for i in range(n)] + [(99, junk, "en", "s", 0)]
        judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
        seen.append({r["doc_id"]: r for r in judged.collect()})
        assert not seen[-1][99]["kept"] and seen[-1][99]["word_distance"] is not None
        assert not seen[-1][0]["base_failed"]
    for name in ("class_distance", "word_distance"):
        assert abs(seen[1][99][name] - seen[2][99][name]) < 0.02


def test_stages_with_clashing_columns(spark):
    import public_tokenizers

    from tallyframe.llm import minhash, mixing, pieces

    names = ["_id", "_place", "_due", "_twin", "pieces", "_key", "n_pieces", "_c1"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(i, f"text number {i} of many " * 8, "en", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (minhash.one_of_each, mixing.mixed_documents):
        made = stage(docs)
        assert made.columns == docs.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in made.collect() for n in names)
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", *names))
    assert {"pieces", "input_pieces", "input_n_pieces", "lossless"} < set(encoded.columns)
    assert all(r["lossless"] and r["input_pieces"] == f"pieces{r['doc_id']}" for r in encoded.collect())


def test_many_licence_places_take_linear_time():
    import time

    from tallyframe.llm import licenses

    scanner = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES, licenses.PERMISSIVE)
    start = time.time()
    found = scanner.scan("x the MIT license, " * 100_000)
    assert (found.n_base, found.first_word, found.last_word) == (100_000, 2, 4 * 100_000 - 2) and time.time() - start < 5
