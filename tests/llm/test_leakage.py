import random

from turnloom.llm.leakage import LeakSearch, leaked_passages, remove_leaked, words_of


def brute(docs, items, m):
    out = {}
    for d, t in docs:
        w = words_of(t)
        for i, s in items:
            v = words_of(s)
            best = 0
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    best = max(best, k)
            if best >= m:
                out[d, i] = best
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(2, 30)))) for i in range(6)]
    docs = []
    for d in range(60):
        t = [rng.choice(vocab + ["x", "y"]) for _ in range(rng.randint(0, 60))]
        if d % 3 == 0:
            s = rng.choice(items)[1].split()
            a = rng.randint(0, len(s))
            t[len(t) // 2 : len(t) // 2] = s[a : a + rng.randint(1, 20)]
        docs.append((d, " ".join(t)))
    return docs, items


def test_random_against_brute_force(spark):
    for seed in range(3):
        docs, items = corpus(seed)
        for words in (40, 2_000_000):
            got = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=5, shard_words=words).collect()
            assert {(r.doc_id, r.item_id): r.n_words for r in got} == brute(docs, items, 5)
            many = leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), min_words=5, max_item_words=25)
            assert {(r.doc_id, r.item_id): r.n_words for r in many.collect()} == brute(docs, items, 5)  # in several passes
            for r in got[:10]:
                a, b = words_of(dict(docs)[r.doc_id]), words_of(dict(items)[r.item_id])
                assert a[r.word_pos : r.word_pos + r.n_words] == b[r.item_pos : r.item_pos + r.n_words]


def test_disguised_and_edge_cases(spark):
    passage = "The gold annotation marks the violin as talk and the copper staircase as change again"
    docs = [(1, "Intro. " + passage.upper().replace(" ", " ") + " end", "a", 1), (2, passage.replace("o", "о").replace("marks", "ma​rks"), "b", 2),
            (3, passage[:40], "c", 3), (4, None, None, None), (5, "", "e", 5), (None, passage, "f", 6), (6, "x " * 50_000 + passage, "g", 7), (1, "other", "h", 8)]
    df = spark.createDataFrame(docs, "doc_id long, text string, id string, n_words int")
    items = spark.createDataFrame([(7, passage, "x"), (7, passage, "y"), (8, "short one", "z"), (9, None, "z"), (None, passage, "z")], "item_id long, text string, item string")
    got = {(r.doc_id, r.item_id, r.n_words) for r in leaked_passages(df, items).collect()}
    assert got == {(1, 7, 15), (2, 7, 15), (6, 7, 15)}
    left = remove_leaked(df, items).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 3, 4, 5]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert leaked_passages(docs, items).collect() == [] and leaked_passages(one, items).collect() == []
    assert LeakSearch([(1, "a b")], 2).shard([(0, ["a", "b"])]).values.tolist() == [[0, 1, 2, 0, 0]]
