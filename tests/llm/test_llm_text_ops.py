"""Licences, decontamination and substring dedup against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from churnlytics.llm import decontaminate as D
from churnlytics.llm import licenses as L
from churnlytics.llm import substrings as S

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}
EDGE = [(1, None), (2, ""), (3, " \n!! "), (4, "MIT License"), (4, "MIT License"), (None, "Apache License, MIT license"),
        (5, "é" * 3000 + " general public LICENSE " + "x" * 200_000)]


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_license_base_matches_plain_search(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    docs = docs.union(frame(spark, EDGE))
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                  for r in L.scan_licenses(docs).collect()), key=repr)
    want = []
    for i, t in docs.collect():
        w, at, labels = words(t), [], set()
        for phrase, label in L.BASE_PHRASES:
            p = phrase.split()
            here = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("text,labels,ok", [
    ("MIT", ["mit"], True), ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only"], True),
    ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only"], False),
    ("GPL-2.0 AND MIT OR Apache-2.0", ["gpl-2.0", "mit", "apache-2.0"], True),
    ("GPL-2.0 AND (MIT OR Apache-2.0)", ["gpl-2.0", "mit", "apache-2.0"], False),
    ("Apache-2.0 WITH LLVM-exception", ["apache-2.0 with llvm-exception"], True),
    ("MIT */", ["mit"], True), ("MIT OR", ["mit"], True), ("(MIT", None, None), ("OR MIT", None, None), ("", None, None)])
def test_license_expressions(text, labels, ok):
    got = L.parse_expression(text)
    assert got == (None if labels is None else (labels, ok))


def test_license_notices_as_they_are_written(spark):
    cases = [
        ("This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0.", "mpl,mpl-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby "
         "granted, provided that", "isc"),
        ("This software is provided 'as-is', without any express or implied\nwarranty.  In no event will the authors be held "
         "liable for", "zlib"),
        ("# This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Redistribution and use in source and binary forms, with or without ... may be used to endorse or promote products\n"
         " derived from this software without specific prior written permission.", "bsd,bsd-3-clause"),
        ("Boost Software License - Version 1.0", "bsl-1.0"), ("CC0 1.0 Universal", "cc0-1.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("the eclipse opened; a public licence", "")]
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(frame(spark, [(k, t) for k, (t, _) in enumerate(cases)])).collect()}
    assert [got[k] for k in range(len(cases))] == [labels for _, labels in cases]
    for k, (phrase, label, _) in enumerate(L.NOTICES):
        r = L.scan_licenses(frame(spark, [(k, phrase.upper())])).first() if k % 6 == 0 else None
        assert r is None or label in r["labels"].split(",")


def test_license_tags_of_any_length(spark):
    names = [f"LicenseRef-vendor-component-{k}" for k in range(20)]
    long = f"({' AND '.join(names)})"
    wide = "SPDX -- License -- Identifier: MIT"
    two = f"SPDX-License-Identifier: MIT {'x ' * 300} SPDX-License-Identifier: GPL-2.0"
    texts = [f"SPDX-License-Identifier: {long} */", f"SPDX-License-Identifier: {'MIT OR ' * 90}GPL-2.0", wide, two,
             f"SPDX-License-Identifier: {'MIT AND ' * 90}GPL-2.0\nMIT", "SPDX-License-Identifier: " + "a or " * 50000 + "mit"]
    rows = {r["doc_id"]: r for r in L.scan_licenses(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["labels"] == ",".join(sorted(n.lower() for n in names)) and rows[0]["permitted"] is False
    assert rows[0]["expressions"] == [long + " */"]
    assert rows[1]["labels"] == "gpl-2.0,mit" and rows[1]["permitted"] is True
    assert rows[2]["expressions"] == ["MIT"] and rows[2]["permitted"] is True
    assert len(rows[3]["expressions"]) == 2 and rows[3]["permitted"] is False
    assert rows[4]["labels"] == "gpl-2.0,mit" and rows[4]["permitted"] is False
    assert rows[5]["labels"] == "a,mit" and rows[5]["permitted"] is True


def test_license_tags_and_clashing_columns(spark):
    df = frame(spark, [(1, "# SPDX-License-Identifier: MIT OR GPL-2.0\ncode", 7)], "doc_id long, text string, n_words int")
    r = L.scan_licenses(df).first()
    assert r["expressions"] == ["MIT OR GPL-2.0"] and r["permitted"] and r["labels"] == "gpl-2.0,mit"
    assert 0.9 < r["score"] < 1 and r["n_base"] == 0
    assert L.scan_licenses(df.limit(0)).count() == 0


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short ITEM"), (3, None), (4, "!!"),
         (None, "no id here"), (2, "short item"), (5, "a a a a a a a a a a a a")]
TEXTS = [(1, "x ONE two, three four five six seven eight nine ten y"), (2, "short, item short item"), (3, None), (4, ""),
         (5, "a a a a a a a a a a a"), (6, "clean text"), (6, "clean text"), (None, "short item"),
         (7, "one two three four five six seven eight nine")]


def plain_contamination(docs, items):
    win = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                win.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k:k + n]) in win and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    names |= win[tuple(w[k:k + n])]
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [1500, D.BROADCAST_BYTES])
def test_contamination_matches_plain(spark, bound):
    docs = frame(spark, TEXTS).withColumn("win", F.lit(1))
    items = frame(spark, ITEMS, "item_id long, text string")
    got = [tuple(r) for r in D.contamination(docs, items, broadcast_bytes=bound).collect()]
    assert sorted(got, key=repr) == plain_contamination(TEXTS, ITEMS)
    assert D.contamination(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in D.contamination(docs, items.limit(0)).collect())


def test_decontaminate_modes(spark):
    docs = frame(spark, TEXTS).withColumn("spans", F.lit("kept")).withColumn("a.b", F.lit(1))
    items = frame(spark, ITEMS, "item_id long, text string")
    whole = D.decontaminate(docs, items)
    assert whole.columns == docs.columns
    assert sorted((r["doc_id"] for r in whole.collect()), key=repr) == sorted([3, 4, 6, 6, 7], key=repr)
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, items, mode="span").collect()}
    assert cut[1] == "x y" and cut[2] == "" and cut[3] is None and cut[6] == "clean text"


def test_substrings_cut_passages_only(spark):
    import numpy as np
    rng = np.random.default_rng(1)

    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(n))
    passage, line = prose(60), prose(9)
    rows = [(k, f"{prose(30 + 7 * k)}\n{passage}\n{prose(25)}") for k in range(5)]
    rows += [(10 + k, f"{prose(40)}\n{line}\n{prose(20)}") for k in range(3)]
    rows += [(20, None), (21, ""), (22, "!!"), (None, passage), (30, rows[0][1]), (31, prose(30000)),
             (40, "same same " * 500), (0, rows[0][1])]
    docs = frame(spark, rows).withColumn("_cut_words", F.lit("x")).withColumn("id", F.lit(3))
    got = S.cut_repeats(docs)
    assert got.columns == [*docs.columns, "_cut_words"]
    by = {}
    for r in got.collect():
        by.setdefault(r[0], []).append((r[1], r[4]))
    assert by[0] == [(rows[0][1], 0)] * 2  # the first occurrence stays, an exact repetition of the row too
    for k in range(1, 5):
        text, n = by[k][0]
        assert n == 60 and not set(passage.split()) & set(text.split())
        assert text.split("\n")[0][:40] == rows[k][1][:40] and text[-40:] == rows[k][1][-40:]
    for k in (10, 11, 12, 22, 31, 21):
        assert by[k][0] == (dict(rows)[k], 0)
    assert by[20] == [(None, 0)] and by[None] == [(passage, 0)]
    assert by[30] == [("", 115)]
    assert S.dedup_substrings(docs).columns == docs.columns
    assert S.cut_repeats(docs.limit(0)).count() == 0


def test_gear_hash_equals_its_recurrence():
    import numpy as np
    table = S.gear_table()
    texts = [b"abc def", b"", "ünïcode text of some length beyond the window".encode()]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    for k, t in enumerate(texts):
        h = 0
        for i, c in enumerate(t):
            h = ((h << 1) + int(table[c])) & 0xFFFFFFFF
            got = S.gear_at(data, off, table, np.array([off[k] + i]), np.array([k]))
            assert int(got[0]) == h


def plain_chunks(text, table):
    """(first byte, last byte + 1, words) of each chunk, word by word."""
    raw = text.encode()
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]

    def gear(stop):
        h = 0
        for c in raw[max(0, stop - 32):stop]:
            h = ((h << 1) + int(table[c])) & 0xFFFFFFFF
        return h
    g = [gear(b) for _, b in spans]
    out, begin = [], 0
    for i in range(len(spans)):
        low = all(g[i] < x for x in g[max(0, i - 3):i]) and all(g[i] <= x for x in g[i + 1:i + 4])
        if low or i == len(spans) - 1:
            for a in range(begin, i + 1, S.MOST_WORDS):
                z = min(a + S.MOST_WORDS - 1, i)
                out.append((spans[a][0], spans[z][1], z - a + 1))
            begin = i + 1
    return out


def plain_cuts(rows, hashes, min_words, min_run):
    table = S.gear_table()
    texts = {(i, hashes[t]): t for i, t in rows if i is not None and t is not None}
    parts = {k: plain_chunks(t, table) for k, t in texts.items()}
    spans = {k: [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", t.encode())] for k, t in texts.items()}
    said = {k: [texts[k].encode()[a:b].lower() for a, b in spans[k]] for k in texts}
    # Place of each chunk's first word, of the word behind its last.
    place = {k: [(sum(n for *_, n in p[:i]), sum(n for *_, n in p[:i + 1])) for i in range(len(p))] for k, p in parts.items()}
    where = {}
    for k, t in texts.items():
        for no, (a, b, _) in enumerate(parts[k]):
            where.setdefault(t.encode()[a:b], []).append((k, no))
    first = {d: min(w) for d, w in where.items()}
    gone = {k: set() for k in texts}
    for k, t in texts.items():
        held = [first[t.encode()[a:b]] for a, b, _ in parts[k]]
        no = 0
        while no < len(held):
            lo, (other, there) = no, held[no]
            no += 1
            if (other, there) == (k, lo):
                continue
            while no < len(held) and held[no] == (other, there + no - lo):
                no += 1
            a, b = place[k][lo][0], place[k][no - 1][1]
            x, y = place[other][there][0], place[other][there + no - 1 - lo][1]
            if b - a < min_run:
                continue
            left = right = 0
            while left < min(a, x, S.BEFORE) and said[k][a - left - 1] == said[other][x - left - 1]:
                left += 1
            while (right < S.AFTER and b + right < len(said[k]) and y + right < len(said[other])
                   and said[k][b + right] == said[other][y + right]):
                right += 1
            if b + right - a + left >= min_words:
                gone[k] |= set(range(a - left, b + right))
    out = []
    for i, t in rows:
        k = (i, hashes[t]) if i is not None and t is not None else None
        if k is None:
            out.append((i, t, 0))
            continue
        raw, new, at = t.encode(), b"", 0
        for w, (_, b) in enumerate(spans[k]):
            new += b"" if w in gone[k] else raw[at:b]
            at = b
        out.append((i, (new + raw[at:]).decode(), len(gone[k])))
    return sorted(out, key=repr)


def test_substrings_match_plain_chunks(spark):
    import random
    rng = random.Random(11)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    shared = [prose(rng.randint(10, 90)) for _ in range(6)]
    rows = [(rng.randint(0, 25), "\n".join(rng.choice([prose(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 5))))
            for _ in range(60)]
    rows += rows[:3] + [(None, shared[0]), (3, None), (4, ""), (5, " .. "), (7, "same " * 700), (8, prose(6000) + shared[1])]
    docs = frame(spark, rows)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    for bound in (0, S.BROADCAST_BYTES):
        got = sorted((tuple(r) for r in S.cut_repeats(docs.repartition(4), broadcast_bytes=bound).collect()), key=repr)
        assert got == plain_cuts(rows, hashes, S.MIN_WORDS, S.MIN_RUN)


def test_substrings_whole_passages_go_and_nothing_else(spark):
    """Found without chunks: of each planted passage of 51 words one copy stays
    and no word of the others, unless they are words of the text around it."""
    import random
    rng = random.Random(23)

    def prose(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    planted, own, rows = [prose(51) for _ in range(150)], {}, []
    for k, p in enumerate(planted):
        for copy in range(3):
            i = 10 * k + copy
            own[i] = (prose(rng.randint(5, 90)), prose(rng.randint(5, 90)))
            sep = ", " if copy == 1 else " "
            rows.append((i, " ".join(own[i][0]) + "\n" + sep.join(p) + "\n" + " ".join(own[i][1])))
    got = {r["doc_id"]: words(r["text"]) for r in S.cut_repeats(frame(spark, rows).repartition(4), min_words=50).collect()}
    whole = 0
    for k, p in enumerate(planted):
        assert got[10 * k] == own[10 * k][0] + p + own[10 * k][1]
        assert got[10 * k + 1] in (own[10 * k + 1][0] + x + own[10 * k + 1][1] for x in ([], p))  # other separators
        # The neighbouring word may agree by chance.
        whole += abs(len(got[10 * k + 2]) - sum(map(len, own[10 * k + 2]))) <= 1
    assert whole == len(planted)


def test_substrings_keep_unrepeated_text_of_a_shared_id(spark):
    import random
    rng = random.Random(5)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(n))
    p, own = prose(80), prose(200)
    got = {r["text"]: r["_cut_words"] for r in S.cut_repeats(frame(spark, [(1, p), (2, p + " " + prose(20)), (2, own)])).collect()}
    assert got[own] == 0 and len(own.split()) == 200 and sum(got.values()) >= 60
