import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from layerlab.llm import hadamard_kmeans, importance, simhash
from layerlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD_TEXTS = [None, "", " \t\n", "one", "One\x0btwo  three", "a b c d", "A\nB c\td", "é É ü", "x" * 30_000, "w " * 60_000]


def brute_fingerprint(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    n = max(1, len(words) - 3)
    shingles = [" ".join(words[i : i + 4]) for i in range(n)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """{row: smallest id} over all pairs."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            parent[find(i)] = find(int(j))
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            r = find(k)
            least[r] = min(i, least.get(r, i))
    return [least.get(find(k)) for k in range(len(fps))]


def test_simhash_query_equals_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components([i for i, _ in rows], fps)
    want = sorted((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, roots))
    got = QUERIES["op11_simhash"](spark, SF)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect())) == want


def test_simhash_of_odd_rows(spark, docs, text_of):
    words = text_of(4, 400)
    near = [*words[:200], "other", *words[201:]]
    texts = [*ODD_TEXTS, " ".join(words), " ".join(near), "A B C D"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "one"), (3, "one"), (None, "a b c d"), (None, "alone here now yes")]
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components([i for i, _ in rows], fps)
    got = simhash.near_duplicates(docs(rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=key) == sorted(
        ((i, f, c) for (i, _), f, c in zip(rows, fps, roots)), key=key
    )
    assert simhash.near_duplicates(docs([]).filter("false")).collect() == []


def kernel_links(fps):
    held = {}
    batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])
    for out in simhash.upper_entries(batch):
        for bucket, blob in zip(out.column(0).to_pylist(), out.column(1)):
            held.setdefault(bucket, []).append(np.frombuffer(blob.as_buffer(), "<u8"))
    return [tuple(map(int, x)) for b, e in held.items() for f in simhash.bucket_links(b, np.concatenate(e)) for x in f]


def flipped(value, bits):
    for b in bits:
        value ^= np.uint64(1) << np.uint64(b)
    return value


@pytest.mark.parametrize("at_once", [1 << 22, 600])
def test_balls_meet_for_every_pair_of_bits(monkeypatch, at_once):
    # 600 is less than the lower variants of two entries: groups are sliced
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    fps = [np.uint64(0), np.uint64(2**64 - 1)]
    for base in rng.integers(0, 2**64, 12, dtype=np.uint64):
        fps.append(base)
        for _ in range(40):
            near = fps[-1] if rng.random() < 0.5 else base
            fps.append(flipped(near, rng.choice(64, rng.integers(1, 7), replace=False)))
    fps = np.unique(np.array(fps, np.uint64))
    links = kernel_links(fps)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {int(f): int(f) for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert [find(int(f)) for f in fps] == brute_components([int(f) for f in fps], fps.tolist())


def test_a_group_of_variants_is_led_not_paired():
    fps = np.unique(np.random.default_rng(1).integers(0, 2**9, 600).astype(np.uint64))
    pairs = sum(1 for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 4)
    assert len(set(kernel_links(fps))) < pairs / 3


def brute_kmeans(rows, k=8, rounds=10, seed=3):
    data = [[math.floor(1024 * float(x)) for x in v] for _, v in rows]
    ids = [i for i, _ in rows if i is not None]
    by_hash = sorted(
        (hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for (i, _), v in zip(rows, data) if i is not None
    )
    centroids = [v for _, v in by_hash[:k]]
    assert ids

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(v, c)), n) for n, c in enumerate(centroids)) for v in data]

    for _ in range(rounds):
        places = assign()
        for n in range(len(centroids)):
            mine = [v for v, p in zip(data, places) if p[1] == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return assign(), centroids


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int, w string")


def test_kmeans_equals_brute_force_with_ties_and_odd_rows(spark):
    r = random.Random(8)
    good = [(k, [r.choice([-1.5, 0.0, 0.25, 2.0]) if k % 2 else r.gauss(0, 1) for _ in range(64)]) for k in range(120)]
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in good]
    good += [good[5], good[5], (7, good[7][1]), (None, good[9][1]), (500, [0.0] * 64), (501, [0.0] * 64)]
    bad = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] + [1.0] * 63), (906, [float("-inf")] * 64)]
    found = hadamard_kmeans.cluster(vector_frame(spark, good + bad))
    places, centroids = brute_kmeans(good)
    assert found.centroids == centroids
    got = sorted(((str(x.vec_id), x.cluster, x.distance) for x in found.rows.collect()))
    assert got == sorted((str(i), n, d) for (i, _), (d, n) in zip(good, places))
    rows = hadamard_kmeans.with_inertia(found).collect()
    assert {x.inertia for x in rows} == {sum(d for d, _ in places)}
    for x in rows:
        assert x.cluster_inertia == sum(d for d, n in places if n == x.cluster)
        assert x.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[x.cluster])).encode()).hexdigest()


def test_kmeans_of_few_far_and_no_vectors(spark):
    few = [(k, [float(k)] * 64) for k in range(3)]
    found = hadamard_kmeans.cluster(vector_frame(spark, few))
    assert len(found.centroids) == 3 and [x.distance for x in found.rows.collect()] == [0, 0, 0]
    far = hadamard_kmeans.cluster(vector_frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1e9] * 64)]))
    assert {x.distance for x in far.rows.collect()} == {0}
    empty = hadamard_kmeans.cluster(vector_frame(spark, few).filter("false"))
    assert hadamard_kmeans.with_inertia(empty).collect() == []
    assert hadamard_kmeans.with_inertia(hadamard_kmeans.cluster(vector_frame(spark, [(None, [1.0] * 64)]))).collect() == []


def test_progressive_search_is_exact_and_keeps_ties():
    rng = np.random.default_rng(2)
    rows, centroids = rng.integers(-3, 4, (400, 64)), rng.integers(-3, 4, (9, 64))
    centroids[6] = centroids[2]
    number, distance = hadamard_kmeans.nearest(hadamard_kmeans.transform(rows), hadamard_kmeans.transform(centroids))
    every = ((rows[:, None] - centroids) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert 6 not in number
    back = hadamard_kmeans.transform_sums_back(hadamard_kmeans.transform(rows).sum(axis=0).tolist())
    assert back == rows.sum(axis=0).tolist()


def brute_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute_resample(rows, target, n_max, buckets, share, min_words):
    def features(text):
        w = brute_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, n_max + 1) for i in range(len(w) - n + 1)]

    source, like = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in features(text):
            source[b] += 1
    for text in target:
        for b in features(text):
            like[b] += 1
    s_all, t_all = sum(source), sum(like)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source, like)]
    out = []
    for i, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        f = features(text)
        weight = sum(gain[b] for b in f)
        out.append([i, len(brute_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0]))
    for place, x in enumerate(fit[: share[0] * len(fit) // share[1]], 1):
        x[5] = place
    return sorted((tuple(map(str, x)) for x in out))


@pytest.mark.parametrize("n_max, buckets", [(1, 10_000), (3, 97)])
def test_resampling_equals_brute_force(spark, docs, text_of, n_max, buckets):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)]
    rows += [(100 + k, " ".join(text_of(k, 15 + k, 300))) for k in range(40)]
    rows += [(200, "Don't STOP\x1cnow x, 日本-été " * 9), (None, "no id " * 20), (201, "no id " * 20)]
    like = [" ".join(text_of(3, 60, 300)), None, "", "日本 stop"]
    target = spark.createDataFrame([(t, 1) for t in like], "text string, bucket int")
    got = importance.resampled(docs(rows), target, n_max, buckets, (30, 100), 20)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(map(str, x)) for x in got.collect()) == brute_resample(rows, like, n_max, buckets, (30, 100), 20)


def test_resampling_of_empty_tables_and_repeated_rows(spark, docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert importance.resampled(docs([]).filter("false"), target).collect() == []
    rows = [(1, "a b c " * 10)] * 5 + [(2, "d e f " * 10)] * 5
    got = importance.resampled(docs(rows), target.filter("false"), share=(50, 100)).collect()
    assert sorted(x["rank"] for x in got if x["rank"] is not None) == [1, 2, 3, 4, 5]
    assert len({x.score for x in got if x["rank"] is not None}) == 1


def test_dictionary_begins_anew_when_full(monkeypatch):
    monkeypatch.setattr(importance, "NEW_WORDS", 3)
    words, r = importance.WordDictionary(most=40), random.Random(6)
    for k in range(300):
        text = "".join(f"w{r.randrange(200)}" + r.choice([" ", ", ", "  ", "-", "\n"]) for _ in range(r.randrange(30)))
        crc, n_bytes = words.scan(text.encode())
        assert [zlib.crc32(w.encode()) for w in brute_words(text)] == crc.tolist()
        assert [len(w) for w in brute_words(text)] == n_bytes.tolist()
        assert words.size <= 40 + len(words.new)
