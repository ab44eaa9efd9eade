import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from layerlab.llm import order_minhash, reply_trees
from layerlab.llm.common import WordHashes
from layerlab.llm.order_minhash import aligned_similarity, labelled_shingles, sketches


def shingles(words):
    return labelled_shingles(WordHashes().of([w.encode() for w in words]))


def test_labels_tell_occurrences_apart():
    s = shingles("a b c d e a b c d e a b c d e".split())
    assert len(set(s.tolist())) == len(s)
    first = shingles("a b c d e x".split())
    assert first[0] == s[0] and len(shingles(list("abcd"))) == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_dynamic_programming(text_of):
    r = random.Random(2)
    for seed in range(120):
        a = shingles(text_of(seed, r.randrange(5, 80)))
        b = a.copy()
        for _ in range(r.randrange(4)):
            k = r.randrange(len(b)) if len(b) else 0
            b = np.concatenate((b[:k], b[k + r.randrange(4) :], b[k : k + r.randrange(3)]))
        b = b[np.sort(np.unique(b, return_index=True)[1])]
        k = lcs(a.tolist(), b.tolist())
        want = k / (len(a) + len(b) - k)
        assert aligned_similarity(a, b) == (want if want >= 0.8 else 0.0)


def test_order_counts(text_of):
    words = text_of(9, 200)
    a, b = shingles(words), shingles(words[100:] + words[:100])
    assert aligned_similarity(a, b) == 0.0
    assert not set(sketches(a).tolist()) <= set(sketches(b).tolist())


def test_sketches_agree_as_often_as_expected(text_of):
    shared = found = 0
    for seed in range(200):
        words = text_of(seed, 100)
        a = shingles(words)
        words[50] = "other"
        b = shingles(words)
        found += len(set(sketches(a).tolist()) & set(sketches(b).tolist()))
        shared += 32 * (91 / 101) ** 5
    assert 0.9 < found / shared < 1.1


def classes(docs, rows):
    out = order_minhash.near_duplicates(docs(rows)).collect()
    return {r.doc_id: r for r in out}


def brute_classes(rows, least=0.8):
    texts = {i: (t or "").split() for i, t in rows}
    s = {i: shingles(w) for i, w in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if texts[a] == texts[b] or aligned_similarity(s[a], s[b], least) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_classes_of_copies_and_edits(docs, text_of):
    r = random.Random(11)
    rows, i = [], 0
    for seed in range(25):
        words = text_of(seed, r.randrange(20, 120))
        for _ in range(r.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(r.randrange(4)):
                own[r.randrange(len(own))] = f"edit{r.randrange(9999)}"
            rows.append((i, " ".join(own)))
            i += 1
    hub = text_of(99, 150)
    for _ in range(60):  # one large group around an original
        own = list(hub)
        for _ in range(r.randrange(1, 3)):
            own[r.randrange(len(own))] = f"edit{r.randrange(9999)}"
        rows.append((i, " ".join(own)))
        i += 1
    rows += [(900, " ".join(hub)), (901, "  ".join(hub)), (902, "a b c"), (903, "a b c"), (904, "a b d"), (905, None), (906, " ")]
    got = classes(docs, rows)
    assert {k: v.class_id for k, v in got.items()} == brute_classes(rows)
    sizes = defaultdict(int)
    for v in got.values():
        sizes[v.class_id] += 1
    assert all(v.class_size == sizes[v.class_id] and v.kept == (k == v.class_id) for k, v in got.items())


def test_groups_are_compared_after_a_round_without_a_link(monkeypatch, docs, text_of):
    # one sketch for all: every text is led by the original, which is far from all others
    def one_sketch(shingles):
        return np.arange(7, 7 + bool(len(shingles)), dtype=np.uint64)

    monkeypatch.setattr(order_minhash, "sketches", one_sketch)
    body, rows = text_of(3, 100), []
    for family in range(6):
        own = list(body)
        for k in range(5):
            own[7 + 17 * k + family] = f"f{family}x{k}"
        for copy in range(3):
            rows.append((10 * family + copy, " ".join([*own, *(f"end{family}-{j}" for j in range(copy))])))
    rows.append((99, " ".join(body)))
    want = brute_classes(rows)
    assert len(set(want.values())) == 7
    assert {k: v.class_id for k, v in classes(docs, rows).items()} == want
    monkeypatch.setattr(order_minhash, "LED_ROUNDS", 1)
    assert {k: v.class_id for k, v in classes(docs, rows).items()} == want


def test_prefix_pairs_hold_every_link(spark, text_of):
    r, texts = random.Random(5), {}
    for seed in range(12):
        body = text_of(seed % 4, r.randrange(6, 60), 60)
        for _ in range(12):
            own = list(body)
            for _ in range(r.randrange(5)):
                k = r.randrange(len(own) - 4)
                own[k : k + r.randrange(2)] = [f"e{r.randrange(99)}"] * r.randrange(2)
            texts[f"{len(texts):03}".encode()] = own
    hashed = {k: WordHashes().of([w.encode() for w in t]) for k, t in texts.items()}
    s = {k: labelled_shingles(h) for k, h in hashed.items()}
    root = {k: k[:2] for k in s}
    frame = spark.createDataFrame([(bytearray(k), len(s[k]), bytearray(root[k])) for k in s], "text_key binary, n long, root binary")
    words = spark.createDataFrame([(bytearray(k), bytearray(h.tobytes())) for k, h in hashed.items()], "text_key binary, words binary")
    got = {(bytes(x.a), bytes(x.b)) for x in order_minhash.prefix_pairs(frame, words, 0.8).collect()}
    want = {(a, b) for a in s for b in s if a < b and root[a] != root[b] and aligned_similarity(s[a], s[b]) > 0}
    assert len(want) > 50 and want <= got and all(root[a] != root[b] for a, b in got)


def test_short_texts_against_brute_force(docs, text_of):
    rows = []
    for seed in range(60):
        for k, (n, more) in enumerate([(8, 1), (9, 1), (12, 2), (13, 2), (20, 3), (36, 8)]):
            words = text_of(100 * seed + k, n + more)
            rows += [(20 * seed + 2 * k, " ".join(words[:n])), (20 * seed + 2 * k + 1, " ".join(words))]
    want = brute_classes(rows)
    assert sum(k != v for k, v in want.items()) == 360
    assert {k: v.class_id for k, v in classes(docs, rows).items()} == want


def test_null_and_repeated_ids(docs, text_of):
    a, b = " ".join(text_of(1, 50)), " ".join(text_of(2, 50))
    out = order_minhash.near_duplicates(docs([(None, a), (3, a), (3, a), (3, b), (None, b + " end")])).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.class_size, r.kept) for r in out) == [
        (0, 3, 2, False), (0, 3, 3, False), (3, 3, 2, True), (3, 3, 3, True), (3, 3, 3, True),
    ]
    assert order_minhash.near_duplicates(docs([])).count() == 0


def test_one_text_is_kept_of_a_class_without_ids(docs, text_of):
    a, b = text_of(1, 60), text_of(2, 60)
    rows = [(None, " ".join(a[:n])) for n in (57, 58, 59, 60)] + [(5, " ".join(b[:n])) for n in (58, 59, 60)]
    out = order_minhash.near_duplicates(docs(rows)).collect()
    assert sorted((r.class_id or 0, r.class_size, r.kept) for r in out) == [(0, 4, False)] * 3 + [(0, 4, True)] + [(5, 3, False)] * 2 + [(5, 3, True)]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(f"{k:03}", f"{k + 1:03}") for k in range(40)] + [("star", f"s{k}") for k in range(30)]
    r = random.Random(1)
    links = spark.createDataFrame(r.sample([p if r.random() < 0.5 else p[::-1] for p in chain], len(chain)), "a string, b string")
    roots = {x.node: x.root for x in order_minhash.components(links).collect()}
    assert set(roots[f"{k:03}"] for k in range(41)) == {"000"}
    assert set(roots[k] for k in [f"s{j}" for j in range(30)] + ["star"]) == {"s0"}


# ---- chats ------------------------------------------------------------------------


def messages(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")


def test_best_branch_of_a_tree(spark):
    rows = [
        (1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0),
        (1, 4, 3, "user", "more", 3.0), (1, 5, 4, "assistant", "end", 3.0), (1, 6, 3, "user", "other", 0.0),
        (2, 7, 99, "user", "orphan", 0.0), (3, 8, 9, "user", "loop", 0.0), (3, 9, 8, "user", "loop", 0.0),
    ]
    best = reply_trees.format_chats(messages(spark, rows), per_tree=2)
    got = {(r.tree, r.leaf): (r.branch_rank, r.branch_score, r.formatted) for r in best.collect()}
    turn = "<|im_start|>{}<|im_sep|>{}<|im_end|>".format
    assert got == {
        (1, 5): (1, 3.0, turn("user", "q") + turn("assistant", "good") + turn("user", "more") + turn("assistant", "end")),
        (1, 6): (2, 2.0, turn("user", "q") + turn("assistant", "good") + turn("user", "other")),
        (2, 7): (1, 0.0, turn("user", "orphan")),
    }


def test_control_strings_come_back(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>", "\\<|im_sep|>\\", "[\\INST]", "\\\\", "<<s>s>", None, "", "é👍\n\n", "x" * 100_000]
    turns = [(1, k, "assistant" if k % 2 else "user<|im_sep|>", t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = reply_trees.format_chats(reply_trees.linear_messages(table))
    read = chats.select(
        "formatted", "loss_mask",
        reply_trees.turns_read_back(F.col("formatted")).alias("turns"),
        reply_trees.learned_text(F.col("formatted"), F.col("loss_mask")).alias("learned"),
    ).first()
    assert [(t.role, t.text) for t in read.turns] == [(r, t or "") for _, _, r, t in turns]
    assert read.learned == "".join(t or "" for k, t in enumerate(texts) if k % 2)
    assert read.formatted.count("<|im_end|>") == len(texts)
    assert [s.end - s.start >= len(texts[2 * k + 1] or "") for k, s in enumerate(read.loss_mask)] == [True] * 5


def test_ties_nulls_and_empty_table(spark):
    turns = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (4, None, None, "x")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    chats = reply_trees.format_chats(reply_trees.linear_messages(table)).collect()
    assert {r.tree.conv: r.n_turns for r in chats} == {None: 3, 4: 1}
    assert reply_trees.format_chats(reply_trees.linear_messages(table.limit(0))).count() == 0


def test_long_conversation(spark):
    turns = spark.range(700).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    row = reply_trees.format_chats(reply_trees.linear_messages(turns)).first()
    want = "".join(f"<|im_start|>user<|im_sep|>{k}<|im_end|>" for k in range(700))
    assert hashlib.md5(row.formatted.encode()).digest() == hashlib.md5(want.encode()).digest()
