import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from spindrift.llm import piece_counts as N
from spindrift.llm import piece_sampling as S
from spindrift.llm import token_output as O
from spindrift.llm.pieces import SPACE, vocabulary
from spindrift.llm.queries import tokenizer_file
from tests.llm import cases

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"
STRANGE = ["", " ", "  a  b ", "▁x ▁▁y", "<0x41> <s> </s> <unk>", "日本語 \U0001f600 ñandú\n\n\tx", "ﬁ é", "a b ", "<|endoftext|> x", "word " * 300]


@pytest.fixture(scope="module")
def bpe():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t


def test_cut_texts_have_the_ids_of_whole_ones(bpe):
    rng = random.Random(1)
    signs = ["a", "b", "é", "ß", " ", " ", ".", ",", "\n", "\t", "!", "'s", "5", "—", "漢", "Ж", "_", "\0", "²", "½", "　", "ª", "\U0001f600", "don't", "\r", "\xa0"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(20_000)] + STRANGE
    texts += ["".join(rng.choices(["ab", "Cé", " ", " ", ".", ",", "\n"], k=9)) for _ in range(20_000)]
    e = O.Encoder(BPE)
    got = [x for k in range(0, len(texts), 500) for x in e.batch(texts[k : k + 500])]
    assert got == [np.array(x.ids, "<u2").tobytes() for x in bpe.encode_batch(texts, add_special_tokens=False)]


def test_frames_hold_all_documents_in_order(spark, bpe):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    coded, table = O.opened(spark, O.encode(docs, BPE, 4))
    starts = {r.part: r.start for r in O.part_starts(coded).collect()}
    got = sorted(O.digests(coded, table).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        ids = [*bpe.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, starts[r.part] + r.at, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    back = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in O.decode(coded, table).collect()}
    assert back[7] == [*bpe.encode(docs.where("doc_id = 7").first().text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n", [0, 1, O.LANES - 1, O.LANES, 3 * O.LANES + 5, O.BLOCK + 17])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint16)
    table = O.Table.of(dict(zip(*(x.tolist() for x in np.unique(np.append(ids, [0, 9]), return_counts=True)), strict=True)))
    assert int(table.freq.sum()) == 1 << O.BITS
    docs = [(5, ids[: n // 3].tobytes()), (None, b""), (-2, ids[n // 3 :].tobytes())]
    raw = O.frame(docs, 77, table)
    first, back = O.unframed(raw, table)
    assert first == 77
    assert [(d, x.tobytes()) for d, x in back] == docs


def test_coding_approaches_the_entropy():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.2, 400_000), 50_000).astype(np.uint16)
    count = np.bincount(ids)
    p = count[count > 0] / len(ids)
    table = O.Table.of({i: int(c) for i, c in enumerate(count) if c})
    assert len(O.frame([(1, ids.tobytes())], 0, table)) * 8 < 1.06 * len(ids) * -(p * np.log2(p)).sum() + 64 * O.LANES * 2


def test_blocks_are_decoded_alone_and_in_any_order(monkeypatch):
    monkeypatch.setattr(O, "BLOCK", 5000)
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, 23_000), 50_000).astype(np.uint16)
    table = O.Table.of({i: int(c) for i, c in enumerate(np.bincount(ids)) if c})
    raw = O.frame([(1, ids[:9000].tobytes()), (2, ids[9000:].tobytes())], 0, table)
    for k in (3, 0, 4, 1, 2):
        assert O.block(raw, k, table).tolist() == ids[5000 * k : 5000 * k + 5000].tolist()
    made = []
    whole = O.block
    monkeypatch.setattr(O, "block", lambda raw, k, *more: made.append(k) or whole(raw, k, *more))
    assert O.stretch(raw, 9990, 10_020, table).tolist() == ids[9990:10_020].tolist()
    assert made == [1, 2]
    # Damage in one block does not keep others from being read.
    at = O.heads(raw, table).blocks[2][4]
    broken = raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]
    assert whole(broken, 3, table).tolist() == ids[15_000:20_000].tolist()
    with pytest.raises(ValueError):
        whole(broken, 2, table)


def test_a_folder_is_all_that_another_session_needs(spark, bpe, tmp_path):
    docs = spark.createDataFrame([(5, "some words"), (3, "and others"), (None, "none")], "doc_id long, text string").withColumn("part", O.F.lit("x")).withColumn("ids", O.F.lit(1))
    O.encode(docs, BPE, 2, f"file://{tmp_path}/out")
    code = f"""
import sys
sys.path.insert(0, {str(__import__("pathlib").Path(O.__file__).parents[2])!r})
from pyspark.sql import SparkSession
from spindrift.llm import token_output as O
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print([(r.doc_id, bytes(r.ids).hex()) for r in O.decode(*O.opened(spark, "file://{tmp_path}/out")).orderBy("part", "at").collect()])
"""
    import subprocess
    import sys

    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200)
    want = [(d, np.array([*bpe.encode(t, add_special_tokens=False).ids, 0], "<u2").tobytes().hex()) for d, t in ((None, "none"), (3, "and others"), (5, "some words"))]
    assert got.stdout.strip() == str(want), got.stderr[-2000:]


def test_damage_is_noticed():
    table = O.Table.of({0: 5, 3: 9})
    raw = O.frame([(1, np.array([3, 3, 0], "<u2").tobytes())], 0, table)
    for broken in (raw[:-1], raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], b"XXXX" + raw[4:]):
        with pytest.raises(ValueError):
            O.unframed(broken, table)
    with pytest.raises(ValueError):
        O.unframed(raw, O.Table.of({0: 1, 3: 1, 4: 1}))


def test_output_of_odd_and_empty_tables(spark):
    coded, table = O.opened(spark, O.encode(cases.odd(spark), BPE, 3))
    got = O.digests(coded, table).collect()
    assert len(got) == len(cases.ODD)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {1}
    coded, table = O.opened(spark, O.encode(cases.empty(spark), BPE, 3))
    assert O.digests(coded, table).count() == 0
    assert O.part_starts(coded).count() == 0


@pytest.fixture(scope="module")
def unigram():
    v = vocabulary(PIECES)
    t = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=v.unknown, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
    return t


def test_counts_are_those_of_the_unigram_tokenizer(spark, unigram):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.n_tokens for r in N.count(docs, PIECES).collect()}
    assert got == {d: len(unigram.encode(t or "", add_special_tokens=False).ids) for d, t in texts.items()}
    c = N.Counter(PIECES)
    assert [c.text(t) for t in STRANGE] == [len(unigram.encode(t, add_special_tokens=False).ids) for t in STRANGE]


def test_ties_take_the_longer_last_piece(unigram):
    v = vocabulary(PIECES)
    flat = Tokenizer(models.Unigram([(p, -1.0) for p in v.pieces], unk_id=v.unknown, byte_fallback=True))
    flat.pre_tokenizer = unigram.pre_tokenizer
    c = N.Counter(PIECES)
    found = v.matcher(value=lambda i: (len(v.pieces[i]), i, -1.0))
    c.iter, c.unknown = found.iter, -11.0
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices("abcdeéñ ß", k=rng.randint(1, 25)))
        assert c.text(text) == len(flat.encode(text, add_special_tokens=False).ids)


def test_long_words_are_counted_and_not_remembered(unigram):
    c = N.Counter(PIECES)
    rng = random.Random(8)
    for n in (63, 64, 65, 5000):
        word = "".join(rng.choices("abcdeß漢tionring", k=n))
        assert c.text(word) == len(unigram.encode(word, add_special_tokens=False).ids)
    assert max(map(len, c)) == 64
    assert c.text("x" * 1_000_000) > 1000


def test_counts_of_odd_and_empty_tables(spark):
    got = N.count(cases.odd(spark), PIECES).collect()
    assert len(got) == len(cases.ODD)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert N.count(cases.empty(spark), PIECES).count() == 0


def segmentations(word, v):
    """All segmentations of a word of the vocabulary's pieces, with their weights."""
    text, known, out = SPACE + word, {v.pieces[i]: i for i in v.normal}, []

    def go(at, ids, score):
        if at == len(text):
            out.append((tuple(ids), np.exp(S.ALPHA * score)))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in known:
                i = known[text[at:end]]
                go(end, [*ids, i], score + v.scores[i])

    go(0, [], 0.0)
    total = sum(w for _, w in out)
    return {ids: w / total for ids, w in out}


def test_samples_follow_the_weights_of_all_segmentations():
    s, word = S.Sampler(PIECES), "hello"
    want = segmentations(word, vocabulary(PIECES))
    n = 40_000
    got = [tuple(x.tolist()) for x in s.encode([word] * n, S.row_keys(list(range(n))))]
    assert set(got) <= set(want)
    for ids, p in want.items():
        if p > 0.01:
            share = got.count(ids) / n
            assert abs(share - p) < 5 * np.sqrt(p * (1 - p) / n), (ids, p, share)


def test_decoding_is_lossless_and_rows_do_not_depend_on_batches():
    s = S.Sampler(PIECES)
    texts = [*STRANGE, None, "x" * 3000, "漢" * 200 + "abc" * 100]
    keys = S.row_keys(list(range(len(texts))))
    coded = s.encode(texts, keys)
    assert [s.decode(x) for x in coded] == [t or "" for t in texts]
    fresh = S.Sampler(PIECES)
    for k in reversed(range(len(texts))):
        assert fresh.encode([texts[k]], keys[k : k + 1])[0].tolist() == coded[k].tolist()
    assert any(a.tolist() != b.tolist() for a, b in zip(coded, s.encode(texts, S.row_keys(list(range(50, 50 + len(texts))))), strict=True))


def test_thresholds_do_not_depend_on_where_a_word_stands():
    words = [*"the of a hello international ñandú x漢 don't".split(), "ab" * 90]
    bits = np.uint64(S.DRAW_BITS)

    def thresholds(s, word):
        a, b = s.first[s.place[word]], s.last[s.place[word]]
        node = (s.cum - np.uint64(1)) >> bits  # of each edge, as its threshold is over 0
        held = (node >= a) & (node <= b)
        return (s.cum[held] - (node[held] << bits)).tolist(), s.piece[held].tolist()

    one, other = S.Sampler(PIECES), S.Sampler(PIECES)
    one.places(words)
    other.places([f"w{k}" for k in range(20_000)])
    for w in reversed(words):
        other.places([w, w + "q"])
    for w in words:
        assert thresholds(one, w) == thresholds(other, w)


def test_forgetting_does_not_change_samples(monkeypatch):
    monkeypatch.setattr(S, "MEMO_NODES", 200)
    s, texts = S.Sampler(PIECES), [f"some words number {k} and others {k * 7}" for k in range(60)]
    keys = S.row_keys(list(range(60)))
    one = [x.tolist() for k in range(0, 60, 4) for x in s.encode(texts[k : k + 4], keys[k : k + 4])]
    monkeypatch.setattr(S, "MEMO_NODES", 10**6)
    assert one == [x.tolist() for x in S.Sampler(PIECES).encode(texts, keys)]


def test_pieces_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert S.round_trips(docs, PIECES).where("not lossless").count() == 0
    back = S.decode(S.encode(docs, PIECES), PIECES).join(docs.withColumnRenamed("text", "whole"), "doc_id")
    assert back.where("text <> coalesce(whole, '')").count() == 0
    got = S.round_trips(cases.odd(spark), PIECES)
    assert got.count() == len(cases.ODD)
    assert got.where("lossless").count() == len(cases.ODD)
    assert got.where("doc_id = 1").select("ids_crc32").distinct().count() == 1
    assert S.round_trips(cases.empty(spark), PIECES).count() == 0
