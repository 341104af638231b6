import random
import re
from collections import Counter

import numpy as np
import pytest

from spindrift.llm import decontamination as D
from spindrift.llm import license_scans as L
from spindrift.llm import sharding as H
from spindrift.llm import url_filters as U
from tests.llm import cases

SF = "/root/testdata/sf0.01"

# -- decontamination ----------------------------------------------------------------------------


def tokens(text):
    out, begins = [], True
    for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+|[.!?\n:;]", text or ""):
        w = m[0]
        if w in ".!?\n:;":
            begins = True
            continue
        low = w.lower()
        if w[0].isdigit() and w[0].isascii():
            out.append(("#", low))
        elif low in D.UNITS:
            out.append(("unit", low))
        elif w[0].isupper() and not w.isupper() and not begins:
            out.append(("name", low))
        else:
            out.append(((low,), None))
        begins = False
    return out


def brute(docs, items):
    """(doc, item) contaminated, comparing every window of every pair."""
    found = set()
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            u = tokens(item)
            vague = not any(sum(isinstance(x, tuple) for x, _ in u[q : q + 8]) >= 4 for q in range(len(u) - 7))
            if vague:
                plain = lambda x: [f or k for k, f in x]
                if len(u) >= 4 and any(plain(t[p : p + len(u)]) == plain(u) for p in range(len(t) - len(u) + 1)):
                    found.add((d, i))
                continue
            hits = [(p, q) for p in range(len(t) - 7) for q in range(len(u) - 7) if [x for x, _ in t[p : p + 8]] == [x for x, _ in u[q : q + 8]] and sum(isinstance(x, tuple) for x, _ in u[q : q + 8]) >= 4]
            shifts = sorted({p - q for p, q in hits})
            lines = [{s} for s in shifts]
            for s in shifts:
                if s - 1 in lines[-1] or s - 2 in lines[-1] or s - 3 in lines[-1]:
                    lines[-1].add(s)
                else:
                    lines.append({s})
            for line in lines:
                mine = [(p, q) for p, q in hits if p - q in line]
                becomes = {}
                for p, q in mine:
                    for k in range(8):
                        if u[q + k][1]:
                            becomes.setdefault(u[q + k][1], set()).add(t[p + k][1])
                torn = any(len(x) > 1 for x in becomes.values())
                covered = {q + k for p, q in mine if not torn or all(u[q + k][1] == t[p + k][1] for k in range(8)) for k in range(8)}
                if covered and (2 * len(covered) >= len(u) or len(covered) >= 13):
                    found.add((d, i))
    return found


ITEMS = [
    (1, "A train leaves Paris at 9 and travels 300 km in 4 hours to reach Lyon before noon today."),
    (2, "Today Tom has 12 apples and gives 5 apples to Anna so how many apples does Tom have now?"),
    (3, "too short to match"),
    (4, "Today Tom has 12 apples and gives 5 apples to Anna so how many apples does Tom have now?"),
    (None, "the quick brown fox jumps over the lazy dog while seven wizards"),
    (6, None),
]
DOCS = [
    (1, "Exercise: A train leaves Paris at 9 and travels 300 km in 4 hours to reach Lyon before noon today. Good luck"),
    (2, "We ask: A train leaves Berlin at 7 and travels 250 miles in 3 hours to reach Hamburg before noon today."),
    (3, "Today Bob has 30 apples and gives 8 apples to Carla so how many apples does Bob have now?"),
    (4, "Today Bob has 30 apples and gives 8 apples to Carla so how many apples does Dan have now?"),
    (5, cases.PROSE),
    (6, None),
    (7, ""),
    (None, ITEMS[0][1]),
    (8, (ITEMS[1][1] + " and then some other words ") * 3),
    (9, "A ship leaves port and travels far in a day to reach an island before noon today"),
]


def test_reparameterised_items_against_brute_force(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matched(docs, items).where("contaminated").collect()}
    assert got == {(d, i) for d, i in brute(DOCS, ITEMS) if d is not None and i is not None}
    assert {d for d, _ in got} == {1, 2, 3, 8}  # in 4 two names stand for one
    rows = {r.doc_id: (r.contaminated, r.n_items, r.best_item) for r in D.verdicts(docs, items).collect()}
    assert rows[3] == (True, 2, 2) and rows[4] == (False, 0, None) and set(rows) == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert {r.doc_id for r in D.keep(docs, items).collect()} == {4, 5, 6, 7, 9, None}


TRAIN = "a train travels 60 km in 40 minutes so how far does it travel in one whole hour at the same speed"
VARIANTS = [
    (1, TRAIN.replace("60", "75").replace("40", "30"), True),
    (2, TRAIN.replace("60", "50").replace("40", "50"), True),  # two slots get one number
    (3, TRAIN.replace("how far", "how very far"), True),  # a word put in
    (4, "a train travels 60 km in 40 minutes and then a bus takes all of us much further on the next day", False),
    (5, "we add 2 3 4 and 5", False),
    (6, "so: 12 + 30 + 7 = 49!", True),
    (7, "so 12 30 8 49", False),
]


def test_what_a_slot_may_become_and_short_items(spark):
    items = spark.createDataFrame([(1, TRAIN), (2, "12 30 7 49"), (3, "no"), (4, "Add 2 3 4")], "item_id long, text string")
    docs = spark.createDataFrame([(d, f"Some words before. {t}. And some after") for d, t, _ in VARIANTS], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in D.verdicts(docs, items).collect()}
    assert got == {d: hit for d, _, hit in VARIANTS} | {5: True}  # by the fourth item


def test_one_changed_slot_does_not_clear_a_long_copy(spark):
    words = [f"word{k}" for k in range(60)]
    words[10] = words[50] = "Anna"
    changed = list(words)
    changed[changed.index("Anna")] = "Berta"
    docs = spark.createDataFrame([(1, "so " + " ".join(changed))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "so " + " ".join(words))], "item_id long, text string")
    assert D.verdicts(docs, items).first().contaminated


def test_runs_of_words_are_hashed_alike_wherever_they_stand():
    names = np.random.default_rng(1).integers(0, 5, 300).astype(np.uint64)
    for long in (1, 4, 9):
        h = D.stretches(names, long)
        want = {}
        for k, x in enumerate(h.tolist()):
            assert want.setdefault(tuple(names[k : k + long].tolist()), x) == x
        assert len(set(want.values())) == len(want)


def test_random_passages_against_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "of", "Anna", "Paris", "12", "7", "km", "so", "we", "go", "there", ".", "Then"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(5, 30)))) for i in range(12)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 60))
        if d % 2:
            part = rng.choice(items)[1].split()
            text[5:5] = part[: rng.randint(6, 40)]
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.item_id) for r in D.matched(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).where("contaminated").collect()}
    assert got == brute(docs, items)


def test_verbatim_items_of_the_given_tables(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    holds = {r.doc_id for r in docs.collect() if any(i.text in (r.text or "") for i in items.collect())}
    got = {r.doc_id for r in D.verdicts(docs, items).where("contaminated").collect()}
    assert holds <= got
    assert len(got - holds) <= 3  # near copies of documents with an item


def test_decontamination_of_odd_and_empty_tables(spark):
    items = spark.createDataFrame([(1, cases.PROSE)], "item_id long, text string")
    odd = cases.odd(spark)
    assert {r.doc_id for r in D.verdicts(odd, items).where("contaminated").collect()} == {1, 5}
    assert D.keep(odd, items).columns == odd.columns
    assert D.verdicts(cases.empty(spark), items).count() == 0
    assert D.verdicts(odd, items.limit(0)).where("contaminated").count() == 0


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.doc_id for r in D.verdicts(docs, items).where("contaminated").collect()} == {1, 2, 3, 8}


# -- URL filters --------------------------------------------------------------------------------


def page_rank(hosts, edges, seeds, rounds=400):
    rank = dict(seeds)
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    for _ in range(rounds):
        new = Counter({h: 0.15 * w for h, w in seeds.items()})
        for (a, b), n in edges.items():
            if a in rank:
                new[b] += 0.85 * rank[a] * n / out[a]
        rank = new
    return rank


PAGES = [
    (1, "https://good.org/a?x=1", '<a href="https://friend.net/x">f</a> <A class=q HREF=\'//friend.net/y\'>g</A> <a href="/own">o</a>'),
    (2, "http://Bad.Example.org/es/1", '<a href="http://worse.net/">w</a>'),
    (3, "https://friend.net/p#top", '<a href="https://third.net">t</a><a href="mailto:x@y.z">m</a><a href="#a">h</a>'),
    (4, "https://spam.net/", '<a href="http://bad.example.org/es/2">b</a><a href="http://sub.com/de/">c</a>'),
    (5, "https://sub.com/de/x", None),
    (6, None, "<a href='http://x.net/'>x</a>"),
    (7, "no scheme", "<p>"),
    (8, "https://worse.net", ""),
    (9, "ftp://third.net?q", "x"),
    (9, "ftp://third.net?q", "x"),
    (10, "https://notorg/x", ""),
    (11, "https://org", ""),
    (12, "https://a.example.org/en/17", ""),
]
PAGE_SCHEMA = "page_id long, url string, html string"


def test_rules_hosts_and_ranks(spark):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA).selectExpr("*", "'x' AS verdict", "1 AS trust")
    got = U.judge(pages).collect()
    assert len(got) == len(PAGES)
    by = {r.page_id: r for r in got}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("good.org", "/a", "org/", "allow")
    assert (by[2].host, by[2].rule, by[2].verdict) == ("bad.example.org", "example.org/es/", "block")
    assert (by[6].host, by[6].path, by[6].verdict) == ("", "", "allow") and by[7].host == ""
    assert by[10].rule is None and by[11].rule is None and by[11].path == ""
    assert by[12].rule == "example.org/en/1"
    assert by[4].verdict == "block" and by[4].distrust > by[4].trust  # links to blocked hosts
    assert by[3].verdict == "allow" and by[3].trust > 0
    edges = {("good.org", "friend.net"): 2, ("good.org", "good.org"): 1, ("bad.example.org", "worse.net"): 1, ("friend.net", "third.net"): 1, ("spam.net", "bad.example.org"): 1, ("spam.net", "sub.com"): 1}
    ruled = 4.0
    trust = page_rank(None, edges, {"good.org": 1 / ruled})
    distrust = page_rank(None, {(b, a): n for (a, b), n in edges.items()}, {"bad.example.org": 1 / ruled, "sub.com": 1 / ruled, "a.example.org": 1 / ruled})
    for r in got:
        assert abs(r.trust - trust.get(r.host, 0)) < 1e-7 and abs(r.distrust - distrust.get(r.host, 0)) < 1e-7


def test_trust_and_distrust_reach_far_hosts_in_any_table(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    chain = [(k, f"http://h{k}.net/", link(f"h{k + 1}.net")) for k in range(30)] + [(30, "http://h30.net/", link("bad.com"))]
    good = [(40, "http://good.org/", link("t0.net"))] + [(50 + k, f"http://t{k}.net/", link(f"t{k + 1}.net")) for k in range(25)]
    pages = spark.createDataFrame([*chain, (35, "http://bad.com/de/", ""), *good], PAGE_SCHEMA)
    many = pages.union(spark.range(3000).selectExpr("id + 1000", "'http://else.org/x'", "''"))
    for table in (pages, many):
        got = {r.host: r for r in U.judge(table).collect()}
        assert all(got[f"h{k}.net"].verdict == "block" for k in range(31))
        assert all(got[f"t{k}.net"].verdict == "allow" and got[f"t{k}.net"].trust > 0 for k in range(25))


def test_ranks_settle_in_loops(spark):
    edges = {("good.org", "a.net"): 1, ("a.net", "b.net"): 2, ("b.net", "a.net"): 1, ("b.net", "c.net"): 3, ("c.net", "a.net"): 1}
    html = lambda h: "".join(f'<a href="http://{b}/">x</a>' * n for (a, b), n in edges.items() if a == h)
    pages = spark.createDataFrame([(k, f"http://{h}/", html(h)) for k, h in enumerate(["good.org", "a.net", "b.net", "c.net"])], PAGE_SCHEMA)
    want = page_rank(None, edges, {"good.org": 1.0})
    got = {r.host: r.trust for r in U.judge(pages).collect()}
    assert all(abs(got[h] - want[h]) < 1e-5 * want[h] for h in got)


def test_no_python_on_the_main_path_and_empty_pages(spark):
    assert U.judge(spark.createDataFrame([], PAGE_SCHEMA)).count() == 0
    plan = U.judge(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- license scans ------------------------------------------------------------------------------


def scanned(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    starts, labels = [], set()
    for phrase, label in L.BASE:
        p = phrase.split(" ")
        here = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        starts += here
        labels |= {label} if here else set()
    body, finds = " " + "".join(w + " " for w in words), []
    for place, label, key, tier, expression in L.rules():
        if key in body:
            for m in re.finditer(expression, body):
                a = body[: m.start()].count(" ")
                finds.append((a, a + m[0].count(" "), tier, place, label))
    stay = set()
    for f in finds:
        if not any(g is not f and g[2] >= f[2] and g[0] <= f[0] and g[1] >= f[1] and ((g[0], -g[1], -g[2], g[3]) < (f[0], -f[1], -f[2], f[3])) for g in finds):
            stay.add(f)
    score = max((L.CONFIDENCE[f[2]] for f in stay), default=0.5 if labels else 0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {f[4] for f in stay})), score


LICENSED = [
    "Licensed under the Apache License, Version 2.0. MIT License mit license MIT-License",
    "This work is licensed under the GNU General Public License, version 3. See the GNU Lesser General Public License 2.1.",
    "SPDX-License-Identifier: GPL-3.0-or-later Copyright (c) 2020 by X. All rights reserved.",
    "Released under CC BY-NC-SA 4.0; also Creative Commons Attribution NonCommercial ShareAlike 4.0 International License",
    "general public license general public license apache license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this. mit anderen Worten",
    "the bsd 3-clause license and the unlicense, in the public domain: is in the public domain",
    "apache licenses MITlicense commit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Neither the name of the Some Great Group nor the names of its contributors may be used to endorse or promote products",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/ Alle Rechte vorbehalten. Tous droits réservés",
    "1mit license é mit license",
]


def test_scans_against_brute_force(spark):
    rows = [*enumerate(LICENSED), *cases.odd(spark).select("doc_id", "text").where("doc_id is not null").withColumnRenamed("doc_id", "d").selectExpr("d + 100", "text").collect()]
    rng = random.Random(5)
    rows += [(1000 + k, " ".join(rng.choices([*"a b mit license apache the under licensed gnu general public version 2 3 cc by nc 4 0 spdx identifier gpl".split(), "MIT License"], k=40))) for k in range(60)]
    got = L.scan(spark.createDataFrame([(int(d), t) for d, t in rows], "doc_id long, text string"))
    want = Counter((int(d), *scanned(t)) for d, t in rows)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()) == want


def test_scan_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = L.scan(docs).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: scanned(t) for d, t in texts.items()}


def test_scan_keeps_every_row_and_is_native(spark):
    got = L.scan(cases.odd(spark))
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in cases.ODD)
    assert L.scan(cases.empty(spark)).count() == 0
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def variants(expression):
    """Texts that a signature matches: with the first and the last way of each choice, and with and without what may be left out."""
    import itertools
    import re._constants as C
    import re._parser as parser

    def texts(parsed, last, more):
        out = ""
        for op, arg in parsed:
            if op is C.LITERAL:
                out += chr(arg)
            elif op is C.IN:
                kind, x = arg[-1 if last else 0]
                out += chr(x[1 if last else 0]) if kind is C.RANGE else chr(x)
            elif op is C.SUBPATTERN:
                out += texts(arg[3], last, more)
            elif op is C.BRANCH:
                out += texts(arg[1][-1 if last else 0], last, more)
            else:
                assert op is C.MAX_REPEAT, op
                out += "".join(texts(arg[2], last, more) for _ in range(min(arg[1], 8) if more else arg[0]))
        return out

    parsed = parser.parse(expression)
    return {texts(parsed, last, more) for last, more in itertools.product((False, True), repeat=2)}


def test_every_signature_has_its_keyword_and_is_found():
    known = L.rules()
    assert len(known) > 300
    assert len({e for *_, e in known}) == len(known)
    gate = re.compile(L.any_of([key for _, _, key, _, _ in known]))
    for _, label, key, tier, expression in known:
        assert tier in L.CONFIDENCE and label == label.strip() != ""
        words = expression.removeprefix(" (?:").removesuffix(")(?= )")
        for text in variants(words):
            body = f" some words {text} and others "
            assert key in body and gate.search(body), (key, text)
            found = re.search(expression, body)
            assert found and found[0] == f" {text}", (expression, text)
        # The shortest way with its words torn apart, run together or within others is not the signature.
        short = min(variants(words), key=len)
        split = short.split(" ")
        assert not re.search(expression, f" x{short}x "), short
        if len(split) > 1:
            assert not re.search(expression, f" some {' gap '.join(split)} "), short
            assert not re.search(expression, f" some {''.join(split)} "), short


def test_real_notices_have_their_labels(spark):
    got = {r.doc_id: set(r.labels.split(",")) for r in L.scan(spark.createDataFrame(list(enumerate(LICENSED)), "doc_id long, text string")).collect()}
    want = {0: {"apache-2.0", "mit", "apache"}, 1: {"gpl-3.0", "lgpl-2.1", "gpl"}, 2: {"gpl-3.0-or-later"}, 8: {"mit"}, 9: {"gpl-3.0-or-later", "gpl"}, 10: {"bsd", "bsd-3-clause"}, 11: {"apache-2.0"}, 12: {"mpl-2.0"}, 13: {"cc-by-nc-sa-4.0", "all-rights-reserved"}}
    for d, labels in want.items():
        assert labels <= got[d], (d, got[d])
    assert not any(x.startswith("bsd") for d in (0, 1, 2, 4, 8, 9, 11) for x in got[d])


# -- sharding -----------------------------------------------------------------------------------


def test_the_table_is_filled_evenly_and_by_preference():
    names = [f"s{k}" for k in range(20)]
    full = H.filled(dict.fromkeys(names, 1), 4001)
    share = np.bincount(full)
    assert share.max() - share.min() <= 1 and len(full) == 4001 and full.min() == 0
    # Brute force: the first free slot of each shard's whole preference list, in turns.
    order = sorted(names)
    prefer = [[(H._hash(n, "offset") + k * (H._hash(n, "skip") % 4000 + 1)) % 4001 for k in range(4001)] for n in order]
    want = {}
    while len(want) < 4001:
        for k in range(len(order)):
            if len(want) < 4001:
                want[next(s for s in prefer[k] if s not in want)] = k
    assert [want[s] for s in range(4001)] == full.tolist()


def test_few_slots_move_and_weights_count():
    names = {f"s{k}": 1 for k in range(20)}
    before = np.array(sorted(names))[H.filled(names)]
    less = {n: w for n, w in names.items() if n != "s7"}
    after = np.array(sorted(less))[H.filled(less)]
    moved = (before != after) & (before != "s7")
    assert moved.mean() < 0.05
    share = np.bincount(H.filled({"a": 3, "b": 1}))
    assert abs(share[0] / share[1] - 3) < 0.01
    with pytest.raises(ValueError):
        H.filled({})


def test_rows_go_where_the_table_says(spark, tmp_path):
    shards = {"a": 1, "b": 1, "c": 2}
    odd = cases.odd(spark)
    got = H.assign(odd, shards, ["doc_id"], ["doc_id"]).collect()
    names, table = sorted(shards), H.filled(shards)
    assert len(got) == len(cases.ODD)
    assert all(r.shard == names[table[r.slot]] for r in got)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert H.assign(cases.empty(spark), shards, ["doc_id"], ["doc_id"]).count() == 0
    spread = H.assign(spark.range(3000).selectExpr("id", "'hot' AS source"), shards, ["source"], ["id", "source"], ["id"], 16)
    assert spread.select("slot").distinct().count() > 8
    H.write(odd, shards, ["doc_id"], f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(cases.ODD)


def test_names_that_clash(spark, tmp_path):
    shards, df = {"a": 1, "b": 1}, spark.range(50).selectExpr("id AS doc_id", "id * 2 AS slot", "'x' AS shard", "id AS row", "'y' AS c0", "1 AS copies")
    for c in ("slot", "shard", "SHARD"):
        with pytest.raises(ValueError, match="names of the result"):
            H.assign(df, shards, ["doc_id"], [c])
    got = H.assign(df, shards, ["slot"], df.columns, names=("place", "home")).collect()
    assert len(got) == 50 and all((r.slot, r.shard, r.row, r.c0) == (2 * r.doc_id, "x", r.doc_id, "y") for r in got)
    plain = {r.doc_id: r.shard for r in H.assign(df, shards, ["slot"], ["doc_id"]).collect()}
    assert {r.doc_id: r.home for r in got} == plain
    with pytest.raises(ValueError, match="names of the result"):
        H.write(df, shards, ["doc_id"], f"{tmp_path}/no")
    H.write(df, shards, ["slot"], f"{tmp_path}/out", folder="home")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert set(back.columns) == {*df.columns, "home"}
    assert {r.doc_id: r.home for r in back.collect()} == plain
