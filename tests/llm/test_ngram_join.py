import random
from collections import defaultdict

import numpy as np
import pytest

from spindrift.llm import ngram_join as J
from tests.llm import cases


def brute(rows):
    """class_id and n_links by comparing every pair that shares a shingle, on sets of word tuples."""
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    post, common = defaultdict(list), defaultdict(int)
    for d in sorted(sets):
        for s in sets[d]:
            for e in post[s]:
                common[e, d] += 1
            post[s].append(d)
    links, near = defaultdict(int), defaultdict(set)
    for (a, b), c in common.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c) - 1e-9:
            links[a] += 1
            links[b] += 1
            near[a].add(b)
            near[b].add(a)
    group = {}
    for d in sorted(sets):
        if d not in group:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = d
                    todo += near[x]
    return {d: (group[d], links[d]) for d in sets}


def test_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, shared = [], " ".join(rng.choices(vocabulary, k=60))
    for g in range(40):
        base = rng.choices(vocabulary, k=rng.randint(3, 150))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words) + (" " + shared if g % 3 == 0 else ""))
    hot = rng.choices(vocabulary, k=120)
    for _ in range(700):  # more than two blocks of one group
        words = list(hot)
        words[rng.randrange(120)] = rng.choice(vocabulary)
        rows.append(" ".join(words))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def near_copies(n, seed=6, words=120):
    """n texts that differ from one in a word or two, each in its own way."""
    rng = random.Random(seed)
    base, out = rng.choices([f"w{i}" for i in range(300)], k=words), []
    for k in range(n):
        some = list(base)
        for _ in range(rng.randint(1, 2)):
            some[rng.randrange(words)] = f"x{rng.randrange(60)}"
        out.append(" ".join([*some, f"end{k}"]))
    return out


def test_blocks_of_a_group_and_connections_by_bucket(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 2)
    monkeypatch.setattr(J, "STRIP", 3)
    monkeypatch.setattr(J, "PAIRS", 5)
    long = [f"v{i}" for i in range(900)]
    chain = [" ".join(long[3 * k : 3 * k + 60]) for k in range(280)]  # each is near its neighbours alone
    rows = list(enumerate(near_copies(12) + chain))
    found = J.compared(spark.createDataFrame(rows, "doc_id long, text string"))
    bands = {r.band for r in found.cells.select("band").distinct().collect()}
    assert -1 in bands
    assert len(bands) > 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("n", [300, 1200, 4000])
def test_rows_grow_with_a_group_and_not_with_its_square(spark, n):
    found = J.compared(spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string"))
    assert found.cells.count() == n
    assert found.links.count() == n
    own, edges = J.root_edges(found.links.select("rep", "root"))
    assert own.count() == n
    assert edges.count() == 0


def test_blocks_ship_a_member_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 100)
    found = J.compared(spark.createDataFrame(list(enumerate(near_copies(1000))), "doc_id long, text string"))
    assert found.cells.count() == 10 * 1000
    _, edges = J.root_edges(found.links.select("rep", "root"))
    assert edges.count() < 10


def test_the_given_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(docs).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    got = {r.doc_id: (r.rep_id, r.class_id, r.n_links) for r in J.join(cases.odd(spark)).collect()}
    assert got == {1: (1, 1, 1), 2: (2, 2, 0), 3: (3, 3, 0), 4: (4, 4, 0), 5: (1, 1, 1), 6: (6, 6, 0), 8: (8, 8, 0), 9: (9, 9, 0)}
    kept = J.first_of_groups(cases.odd(spark))
    assert kept.columns == cases.odd(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "3", "4", "6", "8", "9", "None"])


def test_empty_table(spark):
    assert J.join(cases.empty(spark)).count() == 0
    assert J.first_of_groups(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("n", [32, 64, 160])
def test_pruning_keeps_what_may_reach_the_threshold(n):
    m = J.least_matches(n)
    draw = np.random.default_rng(1).beta(m + 1, n - m + 1, 400_000)
    assert (draw >= 0.8).mean() < 1e-3
    assert m < 0.8 * n
    assert J.least_matches(n, 0.8, 1e-3) >= m


def test_sketches_estimate_the_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(100, 1100, dtype=np.uint64)
    names = [np.unique(J.mix64(x + np.uint64(7))) for x in (a, b)]
    same = (J.sketch(names[0]) == J.sketch(names[1])).mean()
    assert abs(same - 900 / 1100) < 0.1


def test_intersections_by_product_and_one_by_one(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(30)]
    a, b = np.triu_indices(30, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)]
    for product in (0, 1 << 40):
        monkeypatch.setattr(J, "PRODUCT", product)
        assert J.Overlaps(sets).of(a, b).tolist() == want
        assert J.Overlaps(sets).of(a[100:], b[100:]).tolist() == want[100:]


def test_labels_of_links_that_come_in_parts():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    label = np.arange(500)
    for k in range(0, 400, 50):
        label = J.joined(label, a[k : k + 50], b[k : k + 50])
    want = np.arange(500)
    for _ in range(500):
        for x, y in zip(a, b, strict=True):
            want[x] = want[y] = min(want[x], want[y])
    assert label.tolist() == want.tolist()


def test_long_texts_and_words(spark):
    long = " ".join(f"v{k % 5000}x{k // 5000}" for k in range(100_000))
    rows = [(1, "x" * 1_000_000), (2, "x" * 1_000_000), (3, "x" * 999_999), (4, long), (5, long + " and more"), (6, "y")]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0)}
