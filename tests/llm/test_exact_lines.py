import hashlib
import random
import re
from collections import defaultdict

from layerlab.llm import exact_dedup, line_dedup
from layerlab.llm.common import documents
from layerlab.llm.exact_dedup import CuckooFilter, DigestIndex


def digest(k):
    return hashlib.sha256(str(k).encode()).digest()


def test_filter_finds_all_and_forgets_deleted():
    filt = CuckooFilter.sized_for(3000)
    kept = [digest(k) for k in range(3000)]
    assert all(filt.insert(d) for d in kept)
    assert all(filt.may_hold(d) for d in kept)
    for d in kept[:1500]:
        filt.delete(d)
    assert all(filt.may_hold(d) for d in kept[1500:])
    assert sum(filt.may_hold(digest(k)) for k in range(10_000, 20_000)) < 40


def test_filter_overflow_is_rebuilt_from_keys():
    keys = [digest(k) for k in range(200)]
    small = CuckooFilter(4)
    assert not all(small.insert(d) for d in keys)
    filt = CuckooFilter.of(keys, 4)
    assert filt.buckets >= 64 and all(filt.may_hold(d) for d in keys)


def brute_groups(rows):
    ids = defaultdict(list)
    for i, t in rows:
        ids[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return {
        i: (min(v), len(v), hashlib.sha256(t.encode()).hexdigest()) for t, v in ids.items() for i in v
    }


def test_groups(docs):
    rows = [(5, "a  b"), (2, "a\tb"), (9, "a b "), (1, None), (3, ""), (4, "é" * 100_000), (6, "x y")]
    found = exact_dedup.exact_duplicates(docs(rows)).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.digest.hex()) for r in found}
    assert got == brute_groups(rows)
    assert {r.doc_id for r in found if r.kept} == {2, 9, 1, 4, 6}


def test_repeated_rows_and_null_ids(docs):
    found = exact_dedup.exact_duplicates(docs([(1, "a"), (1, "a"), (None, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in found) == [
        (-1, -1, 1, True), (-1, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True),
    ]
    assert exact_dedup.exact_duplicates(docs([])).count() == 0


def test_index_grows_and_shrinks(spark, docs):
    index = DigestIndex.empty(spark, 10).insert(docs([(1, "a"), (2, "a"), (3, "b")]))
    index = index.insert(docs([(0, "b"), (4, "c")]))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.groups().collect()} == {
        1: (1, 2), 2: (1, 2), 3: (0, 2), 0: (0, 2), 4: (4, 1),
    }
    index = index.delete(spark.createDataFrame([(1,), (4,), (99,)], "doc_id long"))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in index.groups().collect()} == {
        2: (2, 1), 3: (0, 2), 0: (0, 2),
    }
    again = index.insert(docs([(7, "c"), (8, "a")]))
    assert {r.doc_id: r.keep_id for r in again.groups().collect()} == {2: 2, 3: 0, 0: 0, 7: 7, 8: 2}


# ---- lines ------------------------------------------------------------------------


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def brute_lines(rows, least):
    having = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            having[key_of(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key_of(x) or len(having[key_of(x)]) < least]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_frequent_lines(docs):
    r = random.Random(3)
    pool = ["Alpha", " alpha ", "beta", "", "  ", "gamma\r", "Ünïcode", "a" * 5000, "x"] + [
        f"line {k}" for k in range(40)
    ]
    rows = [(k, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for k in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "very common")]
    rows += [(k, f"very common\nown {k}") for k in range(2000, 2400)]
    got = {
        r.doc_id: (r.n_lines, r.n_dropped, r.text)
        for r in line_dedup.line_dedup(docs(rows), 10).collect()
    }
    assert got == brute_lines(rows, 10)


def test_first_occurrence_stays(docs):
    rows = [(3, "a\nb\na"), (1, "b\nA\nc"), (2, "c\n\n\nd"), (None, "a\nz")]
    kept = line_dedup.line_dedup(docs(rows), None).collect()
    texts = {r.doc_id: r.text for r in kept}
    # rows without an id come first
    assert texts == {None: "a\nz", 1: "b\nc", 2: "\n\nd", 3: ""}
    bitmaps = line_dedup.keep_bitmaps(documents(docs(rows)), None).collect()
    row = next(b for b in bitmaps if b.doc_id == 2)
    assert line_dedup.unpacked(row.keep, row.n_lines).tolist() == [False, True, True, True]


def test_repeated_rows_count_once_and_empty_table(docs):
    rows = [(1, "same")] * 30 + [(2, "same")]
    assert {r.n_dropped for r in line_dedup.line_dedup(docs(rows), 10).collect()} == {0}
    assert line_dedup.line_dedup(docs(rows), 10).count() == 31
    assert line_dedup.line_dedup(docs([]), 10).count() == 0
