import random

import numpy as np
from pyspark.sql import functions as F

from layerlab.llm import decontaminate, toxicity


def corpus(text_of, n=1200, seed=0):
    """Two kinds of bad words; every fourth text has two to six of them."""
    r = random.Random(seed)
    bad = [f"vile{a}" for a in "abcdefgh"] + ["rotten", "nasty"]
    rows = []
    for k in range(n):
        words = text_of(10_000 * seed + k, r.randrange(5, 80), 3000)
        if k % 4 == 0:
            for _ in range(r.randrange(2, 7)):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((k, " ".join(words)))
    return rows


def test_ordinal_fit_orders_thresholds_and_recovers_grades():
    r = np.random.default_rng(3)
    weights, rows, grades = np.array([2.5, 1.5, 0.0, 0.0, 0.0]), [], []
    for _ in range(4000):
        x = np.flatnonzero(r.random(5) < 0.4)
        noise = r.logistic()
        grades.append(int((weights[x].sum() + noise > np.array([1.0, 3.0])).sum()))
        rows.append(x)
    w, t = toxicity.fit_ordinal(rows, np.array(grades), 5, penalty=1e-6)
    assert t[0] < t[1]
    assert np.allclose(t, [1.0, 3.0], atol=0.3) and np.allclose(w, weights, atol=0.3)


def test_gradient_is_zero_at_the_optimum_of_the_thresholds():
    grades = np.array([0] * 50 + [1] * 30 + [2] * 20)
    _, t = toxicity.fit_ordinal([np.empty(0, int)] * 100, grades, 1)
    assert np.allclose(1 / (1 + np.exp(t)), [0.5, 0.2], atol=1e-3)


def test_held_out_documents(spark, docs, text_of):
    train, test = corpus(text_of, seed=1), corpus(text_of, seed=2)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in train], "doc_id long, toxic int")
    model = toxicity.fit(docs(train), labels)
    out = toxicity.graded(docs(test), model).select("doc_id", "toxicity.*").collect()
    wrong = [r.doc_id for r in out if r.toxic != (r.doc_id % 4 == 0)]
    assert len(wrong) <= 0.02 * len(test)
    assert all(0 <= r.severity <= 2 and r.toxic == (r.p_toxic >= 0.5) for r in out)
    assert {r.grade for r in out} == {0, 1, 2}


def test_labels_without_use(spark, docs, text_of):
    rows = [(k, t) for k, t in corpus(text_of, 40)] + [(None, "x"), (99, None), (98, "")]
    for labels in ([], [(1, None), (None, 1)], [(0, 1), (4, 1)], [(1, 0), (2, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        out = toxicity.graded(docs(rows), toxicity.fit(docs(rows), table)).select("doc_id", "toxicity.*")
        assert out.filter("toxic OR severity > 0").count() == 0 and out.count() == len(rows)


def test_sample_is_bounded_and_most_severe_label_counts(spark, docs):
    rows = [(k, f"text {k}") for k in range(3000)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)] + [(0, 1), (0, 0)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs(rows), labels, max_rows=500)
    assert 350 < sample.count() < 650
    whole = toxicity.labelled_sample(docs(rows), labels)
    assert whole.count() == 3000 and whole.filter("text = 'text 0'").first().toxic == 1


# ---- benchmark ----------------------------------------------------------------------


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_hits(rows, items, window=10):
    out = {}
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            own = words_of(t)
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[k : k + n]:
                        hit.update(range(p, p + n))
                        if item is not None:
                            found.add(str(item))
        out[i] = (len(words), len(hit), sorted(found))
    return out


def hits_of(docs, spark, rows, items, **more):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hit_counts(decontaminate.contaminated_words(docs(rows), bench, **more))
    got = {r.doc_id: (r.n_words, r.n_hit, sorted(r.items)) for r in found.collect()}
    assert found.filter("contaminated <> (n_hit > 0) OR n_items <> size(items)").count() == 0
    return got


def made(text_of):
    r = random.Random(4)
    items = [(k, " ".join(text_of(k, r.randrange(8, 30), 40))) for k in range(12)]
    items += [(20, "one two"), (21, "solo"), (22, None), (23, "--"), (0, items[0][1]), (None, " ".join(text_of(77, 12, 40)))]
    items += [(24, "the the the the the the the the the the the the")]
    rows = []
    for k in range(150):
        words = text_of(500 + k, r.randrange(0, 60), 40)
        if k % 2:
            own = (r.choice(items)[1] or "").split()
            low = r.randrange(max(1, len(own) - 9))
            at = r.randrange(len(words) + 1)
            words[at:at] = own[low : low + r.randrange(5, 20)]
        rows.append((k, r.choice([" ", ", ", "\n"]).join(w.upper() if r.random() < 0.2 else w for w in words)))
    rows += [(900, None), (901, ""), (902, "ONE, two"), (903, "Solo"), (904, "the " * 30), (905, "sóló"), (906, "one-two" * 3)]
    return rows, items


def test_hits_against_all_windows(docs, spark, text_of):
    rows, items = made(text_of)
    assert hits_of(docs, spark, rows, items) == brute_hits(rows, items)


def test_benchmark_in_several_blocks(docs, spark, text_of):
    rows, items = made(text_of)
    assert hits_of(docs, spark, rows, items, block_bytes=300) == brute_hits(rows, items)


def test_empty_tables_and_repeated_rows(docs, spark, text_of):
    assert hits_of(docs, spark, [], [(1, "a b")]) == {}
    assert hits_of(docs, spark, [(1, "a b")], []) == {1: (2, 0, [])}
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    out = decontaminate.contaminated_words(docs([(1, "a b"), (1, "a b"), (None, "b a b")]), bench)
    assert sorted((r.doc_id or 0, list(r.starts), list(r.ends)) for r in out.collect()) == [
        (0, [1], [3]), (1, [0], [2]), (1, [0], [2]),
    ]


def test_prefix_token_is_the_rarest():
    block = decontaminate.ItemBlock.of([("x", b"a b c d e f g h i j")], 10)
    counts = {3: np.full(len(block.shingles[3]), 9)}
    place = np.searchsorted(block.shingles[3], block.key(block.windows[0][4:7]))
    counts[3][place] = 2
    prefixes = block.prefixes(counts)
    assert prefixes[3][place] == [(0, 4)] and sum(map(len, prefixes[3])) == 1
