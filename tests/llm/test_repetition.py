import random

import numpy as np

from leafmill.llm.repetition import _distributed, common_prefixes, measure, repetition, suffix_ranks, tokens


def brute(units, run):
    seen, cover, longest = set(), set(), 0
    for i in range(len(units) - run + 1):
        gram = tuple(units[i : i + run])
        if gram in seen:
            cover.update(range(i, i + run))
        seen.add(gram)
    for i in range(len(units)):
        for j in range(i):
            k = 0
            while i + k < len(units) and units[j + k] == units[i + k]:
                k += 1
            longest = max(longest, k)
    return len(cover), longest if longest >= run else 0


def some(rng, n):
    words = [rng.choice("abc") for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 12:
            a = rng.randrange(n - 10)
            words += words[a : a + rng.randint(5, 12)] * rng.randint(1, 3)
    return words


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    texts = [some(rng, rng.randint(0, 40)) for _ in range(30)]
    symbols = np.array([c for t in texts for c in [*map(ord, t), 0]], np.int64)
    group = np.repeat(np.arange(30), [len(t) + 1 for t in texts])
    order, levels = suffix_ranks(symbols, group)
    at = 0
    shared = common_prefixes(order, levels)
    for t in texts:
        s = [*map(ord, t), 0]
        mine = order[(order >= at) & (order < at + len(s))] - at
        assert list(mine) == sorted(range(len(s)), key=lambda i: s[i:])
        for k, (i, j) in enumerate(zip(mine, mine[1:])):
            want = next((n for n, (x, y) in enumerate(zip(s[i:], s[j:])) if x != y), None)
            assert shared[at + k + 1] == want
        at += len(s)


def test_measure_against_brute_force():
    rng = random.Random(2)
    texts = [some(rng, rng.randint(1, 60)) for _ in range(60)] + [["x"] * 40, ["x"]]
    got = list(zip(*(x.tolist() for x in measure(texts, 5))))
    assert got == [brute(t, 5) for t in texts]


def test_tokens():
    assert tokens("“Der Hund”,  der — HUND!") == (["der", "hund", "der", "hund"], False)
    assert tokens("北方 分部 12") == (list("北方分部12"), True)


def test_whole_and_distributed_agree(spark):
    rng = random.Random(3)
    rows, docs = [], {}
    for d in range(12):
        parts = [" ".join(f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        if d % 3 == 0:
            parts.append(parts[0])
        if d % 4 == 0:
            parts = [p.replace(" ", "").replace("w", "字") for p in parts]
        docs[d] = "\n\n".join(parts)
        rows += [(d, i, p, "x") for i, p in enumerate(parts)]
    rows += [rows[0], (None, 0, "a b", "x"), (77, 0, None, "x"), (78, 0, "", "x"), (79, None, "a b c", "x"), (80, 0, "—", "x")]
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, content string, units string")
    whole = {r.document_id: (r.units, r.repeated, r.share) for r in repetition(df, 4, 6).collect()}
    spread = {r.document_id: (r.units, r.repeated, r.share) for r in repetition(df, 4, 6, whole_chars=0).collect()}
    for d, t in docs.items():
        units, by_char = tokens(t)
        assert whole[d][:2] == (len(units), brute(units, 6 if by_char else 4)[0])
    assert whole == spread and whole[80] == (0, 0, 0.0) and {77, 78, None}.isdisjoint(whole)
    assert repetition(df.limit(0)).count() == 0


def test_large_documents_get_what_small_ones_get(spark):
    rng = random.Random(4)
    docs = {}
    for d in range(8):
        parts = [" ".join(f"w{rng.randint(0, 2)}" for _ in range(rng.randint(20, 60))) for _ in range(4)]
        docs[d] = [*parts, parts[1]] if d % 2 else parts
    docs[8] = ["a " * 75]
    docs[9] = ["one two three four five"]
    # counted by characters, with chunks that hold no Chinese character and repeat each other
    docs[10] = ["北方分部的维护报告" * 3, "ab12 cd34 ef56", "手册", "ab12 cd34 ef56", "北方分部"]
    rows = [(d, i, p) for d, parts in docs.items() for i, p in enumerate(parts)]
    # two contents at one place, stored in either order
    rows += [(11, 0, "c d e f"), (11, 0, "a b g h"), (11, 1, "a b g h c d e f"), (11, 0, "c d e f")]
    df = spark.createDataFrame(rows, "document_id long, chunk_index int, content string")
    whole = {r.document_id: r for r in repetition(df, 4, 6).collect()}
    spread = {r.document_id: r for r in repetition(df, 4, 6, whole_chars=0).collect()}
    blocks = {r.document_id: (r.units, r.repeated, r.longest) for r in _distributed(df, 4, 6, block=16).collect()}
    for d, parts in docs.items():
        units, by_char = tokens("\n\n".join(parts))
        repeated, longest = brute(units, 6 if by_char else 4)
        assert (spread[d].units, spread[d].repeated, spread[d].longest) == (len(units), repeated, longest) == blocks[d]
    assert whole == spread and spread[8].longest == 74 and spread[9].longest == 0 and spread[11].longest == 8
    assert {r.document_id: r.share for r in repetition(df, 4, 6, whole_chars=0, longest=False).collect()} == {d: r.share for d, r in whole.items()}
