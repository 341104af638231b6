import re
import zlib
from collections import Counter

import numpy as np

from spindrift.llm import quality_classifier as C
from spindrift.llm import quality_rules as R
from spindrift.llm.common import ranked
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_statistics_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = R.judge(docs, None).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed)


def test_repeats_of_random_words():
    rng = np.random.default_rng(0)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "b", "c\n", "d"], rng.integers(0, 60)))
        assert R.base_statistics(text) == brute(text)


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, again = brute(text)
    signs = [w for w in words if re.fullmatch(r"[!-/:-@\[-`{-~]", w)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [symbols, len(re.findall("[A-Z]", text)), text.count("!"), len(re.findall("[0-9]", text)), dup, again, sum(a == b for a, b in zip(words, words[1:])), len(signs), chars, n, n, chars, n, len(lines)]


def test_counts_for_the_forest_against_brute_force(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").collect():
        assert R.counts(r.text, R.base_statistics(r.text)) == brute_counts(r.text)
    for t in (None, "", "a", "! ! x x\n\n 7 7 |", "É é"):
        assert R.counts(t, R.base_statistics(t)) == brute_counts(t)
    assert len(R.STATISTICS) == len(brute_counts("a")) - 3 == len(R._PER)


def test_what_lies_beyond_the_usual_against_brute_force():
    rng = np.random.default_rng(3)
    counted = rng.integers(0, 60, (400, len(R.STATISTICS) + 3)).astype(float)
    counted[:, -3:] += 200
    good = rng.random(400) < 0.8
    usual = R.Usual.of(counted, good)
    got = usual.beyond(counted)

    def statistic(row, k):
        name = R.STATISTICS[k]
        if name == "words":
            x = row[-2]
        else:
            per, prior = (row[-3], 100) if name in ("symbols", "capitals", "calls", "digits") else (row[-1], 10) if name in ("lines", "line_words") else (row[-2], 30)
            x = (row[k] + prior * usual.middle[k]) / (max(per, 1) + prior)
        return np.log(min(max(x, R.ENDS[name][0]), R.ENDS[name][1])) if name in R.ENDS else x

    for k in range(len(R.STATISTICS)):
        mine = np.array([statistic(r, k) for r in counted])
        low, high = np.quantile(mine[good], [R.USUAL, 1 - R.USUAL])
        want = [np.log1p(max(x - high, low - x, 0) / max(high - low, 1e-6)) for x in mine]
        assert np.allclose(got[:, k], want)
    assert (got[good] == 0).mean() > 0.99


def test_the_threshold_against_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        good, bad = rng.integers(0, 30, rng.integers(1, 60)) / 30, rng.integers(10, 40, rng.integers(0, 20)) / 30
        t = R.threshold(good, bad, 0.1)
        cost = lambda x: ((bad <= x).sum(), (good > x).sum())
        may = [cost(x) for x in np.unique(np.concatenate([good, bad])) if (good > x).sum() <= 0.1 * len(good)]
        assert cost(t) == min(may)
    assert R.threshold(np.zeros(0), np.ones(3), 0.1) == 1.0


def test_the_forest_finds_unseen_junk_and_keeps_good_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = "crc32(cast(doc_id as string)) % 2 = 0"
    forest = R.fit(docs, labels.where(seen))
    rows = R.judge(docs, forest).join(labels.where(f"not ({seen})"), "doc_id").where("not base_failed").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    share = sum(not r.kept for r in bad) / len(bad), sum(not r.kept for r in good) / len(good)
    print("rows outside the fit: bad", len(bad), "rejected", share[0], "good", len(good), "rejected", share[1])
    assert share[0] > 0.97
    assert share[1] < 0.01


def test_path_lengths_are_those_of_a_walk():
    x = np.random.default_rng(1).normal(size=(200, 3))
    forest = R.Forest.grow(x, trees=5, rows=64)

    def walk(row, at):
        while forest.feature[at] >= 0:
            at = forest.left[at] + int(row[forest.feature[at]] >= forest.cut[at])
        return forest.length[at]

    want = [2 ** -(np.mean([walk(row, r) for r in forest.roots]) / forest.norm) for row in x]
    assert np.allclose(forest.score(x), want)
    assert forest.score(np.array([[30.0, 30, 30]]))[0] > np.quantile(forest.score(x), 0.95)


def test_order_statistics_of_tables_are_exact(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.random(5000), np.zeros(5000), rng.integers(0, 9, 5000), 1e-300 * 10.0 ** rng.integers(0, 600, 5000).clip(0, 300)], 1)
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(7)
    wanted = [(k, r) for k in range(4) for r in (0, 4, 2499, 2500, 4990, 4999)]
    assert ranked(rows, wanted) == [np.sort(x[:, k])[r] for k, r in wanted]


def test_order_statistics_take_one_worker_a_task(spark, monkeypatch):
    x = np.random.default_rng(6).random((300, 3))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>")
    plans, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    counted = np.hstack([np.random.default_rng(7).integers(0, 9, (300, len(R.STATISTICS))), np.random.default_rng(8).integers(10, 99, (300, 3))]).astype(float)
    R.Usual.of_all(spark.createDataFrame([(r.tolist(),) for r in counted], "x array<double>"))
    assert plans and all(p.count("MapInArrow") == 1 for p in plans)
    assert ranked(rows, [(1, 7)], np.sqrt) == [float(np.sort(np.sqrt(x[:, 1]))[7])]


def test_the_forest_learns_from_every_labelled_row(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["aa", "bbb", "cccc", "7", "Dd", "#"], 40, p=[0.3, 0.3, 0.3, 0.04, 0.04, 0.02])) for _ in range(6000)]
    y = (rng.random(6000) < 0.9).astype(int)
    texts = [t if k else t + " # ! 7 X" * 5 for t, k in zip(texts, y, strict=True)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(y)], "doc_id long, quality int")
    forest = R.fit(docs.repartition(5), labels)
    base = [R.base_statistics(t) for t in texts]
    counted, passed = np.array([R.counts(t, b) for t, b in zip(texts, base, strict=True)]), ~np.array([R.failed(b) for b in base])
    usual = R.Usual.of(counted, (y == 1) & passed)  # of all 6000 rows
    assert np.allclose([forest.usual.middle, forest.usual.low, forest.usual.high], [usual.middle, usual.low, usual.high], rtol=1e-12, atol=0)
    score = forest.score(forest.usual.beyond(counted))
    assert np.isclose(forest.threshold, R.threshold(score[(y == 1) & passed], score[(y == 0) & passed], R.LOSS), rtol=1e-12)
    again = R.fit(docs.repartition(3), labels)
    assert (again.threshold, again.cut.tolist()) == (forest.threshold, forest.cut.tolist())


def test_the_threshold_of_a_table_against_that_of_arrays(spark):
    rng = np.random.default_rng(6)
    for n_bad in (0, 3, 20):
        good, bad = rng.integers(0, 30, 50) / 30, rng.integers(10, 40, n_bad) / 30
        rows = spark.createDataFrame([(1, float(x)) for x in good] + [(0, float(x)) for x in bad], "y int, score double")
        for loss in (0.0, 0.1, 0.3):
            assert R.threshold_of_all(rows, 50, loss) == R.threshold(good, bad, loss)


def test_rules_on_odd_and_empty_tables(spark):
    odd = cases.odd(spark)
    got = R.judge(odd, None)
    assert got.count() == len(cases.ODD)
    assert {r.doc_id for r in got.collect() if r.kept} == {1, 5, 6, None}
    assert R.fit(odd, cases.labels(spark)) is None
    assert R.fit(cases.empty(spark), cases.labels(spark, [(1, 0, 0), (2, 1, None), (None, 1, 1)])) is None
    assert R.judge(cases.empty(spark), None).count() == 0
    forest = R.fit(odd, cases.labels(spark, [(1, 1, 0), (1, 1, 0), (8, 0, 0), (5, None, 0)]))
    kept = R.keep(odd, forest)
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 1").count() == 2


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = C.predictions(C.score(docs, C.fit(docs, labels))).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_shards_learn_from_every_labelled_row(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("crc32(cast(doc_id as string)) % 5 <> 0 and quality in (0, 1)")
    seen = []

    def train_shards(bags, shards, count):
        seen.append((shards, count, bags.count(), bags.select("shard").distinct().count()))
        return C.Net.start()

    monkeypatch.setattr(C, "train_shards", train_shards)
    C.fit(docs, labels, local=0)
    n = known.join(docs, "doc_id").select("doc_id").distinct().count()
    shards, count, rows, distinct = seen[0]
    assert n > 3000 and rows == sum(count.values()) == n
    assert shards == distinct == -(-n // C.BATCH)


def test_steps_by_shards_are_steps_on_all_rows(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "words", "here"] if k % 3 else ["%%", "$$", "here"], 150 + k)) for k in range(24)]
    y = [int(k % 3 > 0) for k in range(24)]
    bags = spark.createDataFrame([(0, k, t) for t, k in zip(texts, y, strict=True)], "shard int, y int, text string")
    one, two = (C.train_shards(bags.repartition(n), 1, {0: 8, 1: 16}, 4) for n in (1, 5))
    assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in C.Net.NAMES)
    x, n = C.passages(texts)
    whole = C.train(x.astype(np.float32), n, np.array(y), 4)
    assert all(np.allclose(getattr(one, k), getattr(whole, k), atol=1e-4) for k in C.Net.NAMES)


def test_held_out_accuracy_of_shards(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = C.predictions(C.score(docs, C.fit(docs, labels, local=0))).join(labels, "doc_id").where("held_out").collect()
    print("shards: rows held out", len(got), "wrong", sum(r.predicted != r.quality for r in got))
    assert np.mean([r.predicted == r.quality for r in got]) > 0.97


def brute_score(net, text):
    """The forward pass of one text, passage by passage and number by number."""
    raw = (text or "").encode()
    embedded, energy = [], []
    for at in range(0, max(len(raw), 1), C.PASSAGE):
        part = raw[at : at + C.PASSAGE]
        seen = np.zeros(C.WIDTH)
        for k, b in enumerate(part):
            seen[C.CLASS[b]] += 1
            if k:
                seen[C.CLASSES + C.CLASS[part[k - 1]] * C.CLASSES + C.CLASS[b]] += 1
        seen[: C.KINDS - 1] /= max(len(part), 1)
        grams = [int.from_bytes(part[k : k + 3], "big") * 2654435761 % 2**32 * C.BUCKETS >> 32 for k in range(len(part) - 2)]
        for g in grams:
            seen[C.KINDS + g] += 1 / len(grams)
        seen = np.sqrt(seen)
        seen[C.KINDS - 1] = len(part) / C.PASSAGE
        h = [np.tanh(sum(seen[i] * net.w[i, j] for i in np.flatnonzero(seen)) + net.b[j]) for j in range(C.HIDDEN)]
        gate = [np.tanh(sum(h[j] * net.v[j, a] for j in range(C.HIDDEN))) / (1 + np.exp(-sum(h[j] * net.u[j, a] for j in range(C.HIDDEN)))) for a in range(C.ATTENTION)]
        embedded.append(h)
        energy.append(sum(g * x for g, x in zip(gate, net.a, strict=True)))
    weight = [np.exp(e) / sum(np.exp(x) for x in energy) for e in energy]
    z = [sum(w * h[j] for w, h in zip(weight, embedded, strict=True)) for j in range(C.HIDDEN)]
    return 1 / (1 + np.exp(-sum(x * o for x, o in zip(z, net.o, strict=True)) - net.c[0]))


def test_the_forward_pass_against_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 40 = 0 and n_chars < 4000").collect()] + ["", None, "ab", "é" * 300 + "x" * 900]
    x, n = C.passages(texts)
    net = C.train(x.astype(np.float32), n, np.arange(len(texts)) % 2, epochs=4)
    assert np.allclose(C.scores(net, texts), [brute_score(net, t) for t in texts], atol=1e-9)


def test_sampled_passages_are_spread_over_the_text():
    raw = C.sampled(["a" * 100_000, "b", None])
    bags = [np.frombuffer(b, "<f4").reshape(-1, C.WIDTH) for b in raw]
    assert [len(b) for b in bags] == [C.MOST, 1, 1]
    whole, _ = C.passages(["a" * 100_000])
    assert np.allclose(bags[0][-1], whole[-1].astype(np.float32))


def test_attention_weights_and_slopes():
    rng = np.random.default_rng(2)
    net, x, n, y = C.Net.start(), rng.random((7, C.WIDTH)), np.array([3, 1, 3]), np.array([1, 0, 1])
    each = np.array([0.2, 0.3, 0.5])

    def loss():
        p = net.score(x, n)
        return -(each * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    slopes = net.slopes(x, n, y, each)
    for name in C.Net.NAMES:
        part = getattr(net, name)
        at = tuple(rng.integers(0, s) for s in part.shape)
        keep, h = part[at], 1e-6
        part[at] = keep + h
        up = loss()
        part[at] = keep - h
        down = loss()
        part[at] = keep
        assert abs((up - down) / (2 * h) - slopes[name][at]) < 1e-6
    _, (_, bag, *_, weight, _) = net.forward(x, n)
    assert np.allclose(np.bincount(bag, weight), 1)


def test_passages_cover_whole_texts():
    texts = ["", None, "é" * 700, "abc " * 5000]
    x, n = C.passages(texts)
    assert n.tolist() == [1, 1, 3, 40]
    assert np.isclose(x[:, C.KINDS - 1].sum() * C.PASSAGE, 1400 + 20000)


def test_scores_do_not_depend_on_batches():
    net = C.train(*C.passages(["good words here"] * 3 + ["%%% $$$"] * 3), np.array([1, 1, 1, 0, 0, 0]), epochs=3)
    texts = ["a b c", None, "", "x" * 3000, "%%%"]
    assert np.allclose(C.scores(net, texts), np.concatenate([C.scores(net, [t]) for t in texts]))


def test_long_texts_are_seen_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(["good", "words", "é%%", "here."], 150_000))
    net, raw = C.Net.start(), text.encode()
    assert len(raw) > 2 * C.GROUP
    x, n = C.passages([text])
    sizes, seen = [], C.seen

    def watched(raws):
        sizes.append(sum(map(len, raws)))
        return seen(raws)

    monkeypatch.setattr(C, "seen", watched)
    texts = ["a b", text, None, text[:5000]]
    assert np.allclose(C.scores(net, texts), [brute_score(net, t) for t in texts], atol=1e-9)
    got = C.summed(net, [text], [1], {1: 0.5})
    assert max(sizes) <= C.GROUP and sum(sizes) > 3 * len(raw)
    slopes = net.slopes(x, n, np.array([1]), np.array([0.5]))
    assert np.allclose(got * 2.0**-C.BITS, np.concatenate([slopes[k].ravel() for k in C.Net.NAMES]), atol=1e-5)


def test_classifier_on_odd_and_empty_tables(spark):
    odd = cases.odd(spark)
    assert C.score(odd, None).count() == len(cases.ODD)
    assert C.fit(odd, cases.labels(spark)) is None
    net = C.fit(odd, cases.labels(spark, [(i, i % 2, 0) for i in range(10)] + [(2, 1, 1), (None, 0, 0)]))
    assert C.predictions(C.score(odd, net)).where("doc_id is null and not held_out").count() == 1
    assert C.keep(odd, net, 0.0).columns == odd.columns
    assert C.keep(odd, net, 0.0).count() == len(cases.ODD)
    assert C.score(cases.empty(spark), net).count() == 0
