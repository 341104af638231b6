from collections import Counter

import corpus_pipeline as P
import __spark_entry__ as E
from spindrift.llm import piece_sampling
from spindrift.llm.queries import tokenizer_file
from tests.llm import cases
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_quality import brute as statistics

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for _, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        kept.append({r.doc_id: r for r in docs.collect()})
        if len(kept) < len(P.STAGES):
            assert docs.columns == before.columns
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert not any((s := statistics(first[d]))[0] < 10 or 100 * s[4] > 20 * s[0] for d in kept[0])
    near = groups([(d, r.text) for d, r in kept[1].items()])
    assert set(kept[2]) == {d for d, (g, _) in near.items() if g == d}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in kept[3].values() for i in items)
    assert set(kept[4]) == set(kept[3])
    assert {r.doc_id: r.n_tokens for r in P.run(spark, SF).collect()} == {d: r.n_tokens for d, r in kept[4].items()}


def test_stages_on_odd_and_empty_tables(spark):
    whole = Counter(map(tuple, cases.odd(spark).collect()))
    for docs in (cases.odd(spark), cases.empty(spark)):
        full = docs.columns == cases.odd(spark).columns and docs.count() > 0
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, SF)
            if k == len(P.STAGES) - 1:
                texts = {r.doc_id: r.text for r in docs.collect()}
                assert {r.doc_id: r.text for r in piece_sampling.decode(out, tokenizer_file("piece_bpe_32k.model")).collect()} == {d: t or "" for d, t in texts.items()}
                assert out.count() == docs.count()
                continue
            assert out.columns == docs.columns
            rows = Counter(map(tuple, out.collect()))
            assert rows <= whole  # whole rows, each as often as it was there or less
            ids = {r[0] for r in rows}
            if full:
                assert {1, None} <= ids or k > 1
                assert name != "quality rules" or not ids & {2, 3, 4, 9}  # under ten words
                assert name != "n-gram Jaccard join" or (1 in ids and 5 not in ids)
            else:
                assert not rows


def test_the_classifier_learns_from_all_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held_out = labels.where("quality is not null and crc32(cast(doc_id as string)) % 5 = 0")
    left = {q: docs.join(held_out.where(f"quality = {q}"), "doc_id", "left_semi") for q in (0, 1)}
    n, kept = ({q: df.count() for q, df in one.items()} for one in (left, {q: P.by_classifier(spark, df, sf) for q, df in left.items()}))
    print(n, kept)
    assert n[0] and kept[0] < 0.1 * n[0]
    assert kept[1] > 0.97 * n[1]


def test_all_are_registered():
    names = E.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
