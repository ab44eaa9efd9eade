import random
from collections import Counter, defaultdict

import pytest

from layerlab.llm import relative_lz, repeats
from layerlab.llm.common import WordHashes, documents, gram_hashes, leftmost_minima

import numpy as np


def test_minima_and_grams_against_loops():
    r = np.random.default_rng(1)
    values = r.integers(0, 1 << 63, 500, dtype=np.uint64)
    values[100:140] = values[100]
    for width in (1, 2, 7, 137):
        want = [int(k + np.argmin(values[k : k + width])) for k in range(len(values) - width + 1)]
        assert leftmost_minima(values, width).tolist() == want
    units = r.integers(0, 5, 300, dtype=np.uint64)
    for k in (1, 3, 5, 13, 64):
        hashes, parts = gram_hashes(units, k).tolist(), [tuple(units[j : j + k]) for j in range(301 - k)]
        assert len(hashes) == len(parts) and len(set(zip(hashes, parts))) == len(set(parts)) == len(set(hashes))


def made(seed, n_docs, text_of, hot):
    """Documents with shared passages; a third of them hold one passage."""
    r = random.Random(seed)
    pool = [text_of(s, r.randrange(10, 60)) for s in range(12)]
    rows = []
    for k in range(n_docs):
        words = text_of(1000 + k, r.randrange(0, 40))
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(pool)[r.randrange(8) :]
        if k % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = hot
        rows.append((k, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(5000 + k, rows[7][1]) for k in range(30)] + [(6000, None), (6001, ""), (6002, "é" * 700)]
    return rows


def brute_words(rows, window=13):
    first = defaultdict(lambda: 1 << 62)
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first[g], i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def brute_bytes(rows, window=200):
    count = Counter()
    data = {i: (t or "").encode() for i, t in rows}
    for b in data.values():
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("partitions", [3, 40])
def test_words_of_earlier_documents(spark, docs, text_of, partitions):
    rows = made(1, 240, text_of, text_of(77, 50))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = relative_lz.substring_dedup(docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_words(rows)


@pytest.mark.parametrize("partitions", [3, 40])
def test_bytes_that_occur_again(spark, docs, text_of, partitions):
    rows = made(2, 200, text_of, text_of(78, 70))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = repeats.repeat_dedup(docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in out}
    assert got == brute_bytes(rows)


def test_segments_of_runs_stay_small(text_of):
    r = random.Random(9)
    for period in range(1, 65):
        word = bytes(r.randrange(256) for _ in range(period))
        text = b"before " + (word * (20_000 // period + 1))[:20_000] + b" after"
        size, seen, covered = 0, set(), np.zeros(len(text), bool)
        for first, end, _, _, runs in repeats._segments(text, 200, 64):
            for a, b in zip(first.tolist(), end.tolist()):
                size += b - a + 199
                seen.update(text[k : k + 200] for k in range(a, b))
            for a, b, _, _ in runs:
                covered[a:b] = True
        assert size <= 5 * len(text)
        assert seen == {text[k : k + 200] for k in range(len(text) - 199)}
        if period < repeats.PERIOD:
            assert size < 2_000 and covered[7:-6].all() and covered.sum() <= len(text) - 10


@pytest.mark.parametrize("partitions", [1, 40])
@pytest.mark.parametrize("piece", [700, 1 << 18])
def test_runs_against_brute_force(monkeypatch, spark, docs, text_of, partitions, piece):
    words = [" ".join(text_of(300 + k, 60)) for k in range(12)]
    texts = [
        "a" * 30_000, "a" * 200, "a" * 199, "b" * 201, "c" * 200, "ab" * 150 + words[0], words[1] + "ba" * 100,
        ("-" * 500 + "\n") * 20, words[2] + " " * 900 + words[3], " " * 900 + words[2], ("xyz" * 70) + ("xy" * 130),
        "".join(chr(33 + k) for k in range(63)) * 9, "".join(chr(33 + k) for k in range(64)) * 9, words[4],
        "d" * 250 + words[5] + "d" * 210, words[6] + "e" * 199 + words[7], "é" * 400, "f" * 199 + "g" * 199, words[8] + "h" * 200,
    ]
    rows = list(enumerate(texts)) + [(100, None), (101, "")]
    monkeypatch.setattr(repeats, "PIECE", piece)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = repeats.repeat_dedup(docs(rows)).collect()
        groups = repeats.repeated_spans(documents(docs([(1, "ab" * 200), (2, "x" + "ba" * 300)])), every=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in out}
    assert got == brute_bytes(rows)
    by_doc = defaultdict(set)
    for s in groups:
        by_doc[s.doc].add(s.repeat)
    assert by_doc[1] & by_doc[2], "runs of one word are one group"


def test_long_text_in_pieces(monkeypatch, docs, text_of):
    words = text_of(5, 3000)
    rows = [(1, " ".join(words)), (2, " ".join(words[700:1500] + text_of(6, 20) + words[:90]))]
    monkeypatch.setattr(repeats, "PIECE", 1000)
    monkeypatch.setattr(relative_lz, "PIECE", 100)
    out = relative_lz.substring_dedup(docs(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_words(rows)
    out = repeats.repeat_dedup(docs(rows)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.starts), bytes(r.kept)) for r in out}
    assert got == brute_bytes(rows)


def test_ids_that_are_null_or_repeated(docs, text_of):
    a, b = " ".join(text_of(1, 40)), " ".join(text_of(2, 40))
    rows = [(None, a), (4, a), (4, b), (4, a), (9, b), (None, b)]
    out = relative_lz.substring_dedup(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 40), (0, 40), (4, 0), (4, 0), (4, 0), (9, 40)]
    out = repeats.repeat_dedup(docs(rows)).collect()
    assert all(r.n_removed == r.n_bytes and not r.kept for r in out) and len(out) == 6
    assert repeats.repeat_dedup(docs([])).count() == relative_lz.substring_dedup(docs([])).count() == 0


def test_repeat_groups_have_all_occurrences(docs, text_of):
    common = " ".join(text_of(3, 80))
    rows = [(k, f"{' '.join(text_of(50 + k, 9))} {common} {' '.join(text_of(80 + k, 9))}") for k in range(5)]
    spans = repeats.repeated_spans(documents(docs(rows)), every=True).collect()
    by_doc = defaultdict(set)
    for s in spans:
        by_doc[s.doc].add(s.repeat)
    assert set.intersection(*by_doc.values()), "one group holds an occurrence in every document"


def test_tree_against_all_pairs():
    r = random.Random(4)
    for _ in range(60):
        members = list({(bytes(r.choice(b"ab") for _ in range(r.randrange(8, 20))), r.randrange(3, 6)) for _ in range(6)})
        window, want, got = 8, defaultdict(set), defaultdict(set)
        for j, (x, p) in enumerate(members):
            for k, (y, q) in enumerate(members):
                if j != k:
                    right = repeats.common_prefix(x[p:], y[q:])
                    left = repeats.common_prefix(x[:p][::-1], y[:q][::-1])
                    want[j] |= set(range(p - left, p + right - window + 1))
        for j, start, end, _ in repeats.maximal_repeats(members, window):
            got[j] |= set(range(start, end - window + 1))
        assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("partitions", [1, 40])
def test_windows_alike_in_half_their_bits(monkeypatch, spark, docs, partitions):
    # hashes that differ in their lower 32 bits only; all windows are in the block of a hot gram
    grams = [[f"h{k}a", f"h{k}b", f"h{k}c"] for k in range(2000)]
    hot = min(grams, key=lambda g: int(gram_hashes(WordHashes().of([w.encode() for w in g]), 3)[0]))

    def lower_half_only(units, k):
        hashes = gram_hashes(units, k)
        return hashes & np.uint64(0xFFFFFFFF) if k == relative_lz.WINDOW else hashes

    monkeypatch.setattr(relative_lz, "gram_hashes", lower_half_only)
    rows = [(k, " ".join([f"d{k}a{j}" for j in range(6)] + hot + [f"d{k}b{j}" for j in range(6)])) for k in range(60)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = relative_lz.substring_dedup(docs(rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert {r.doc_id: r.n_removed for r in out} == {k: 0 for k in range(60)}


def test_factors_end_where_the_reference_does():
    rows = [(1, [1, 2, 3]), (2, [7, 1, 2, 9, 3]), (2, [7]), (3, [7, 1, 2, 3])]
    misses = []
    assert list(relative_lz.factors(rows, misses)) == [(1, 1, 3), (1, 4, 5), (3, 0, 3), (3, 3, 4)]
    assert misses == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 3), (2, 0)]
