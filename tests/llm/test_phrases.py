"""Collocations: the sort against plain counting, both routes, ties and odd rows against a plain version."""

import collections
import random
import re

import numpy as np
import pytest

from furlong.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, c int, route string, n long"
SPLIT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain(rows, least, top, cover=80):
    count, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in SPLIT.split(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            w = WORD.findall(piece)
            total[lang] += len(w)
            count.update((lang, *w[i:i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    found = collections.defaultdict(list)
    for key, a in count.items():
        lang, w = key[0], key[1:]
        if a < least or len(w) < 2:
            continue
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for k in range(1, len(w)) for x, y in [(count[lang, *w[:k]], count[lang, *w[k:]])])
        found[lang].append((w, a, left, right, score))
    out = []
    for lang, rows_ in found.items():
        longer = collections.Counter()
        for w, a, *_ in rows_:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longer[w[i:i + m]] = max(longer[w[i:i + m]], a)
        kept = [(" ".join(w), a, x, y, s) for w, a, x, y, s in rows_ if not longer[w] or 100 * longer[w] < cover * a]
        kept.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, k + 1, r[0], r[1], r[2], r[3], total[lang], r[4]) for k, r in enumerate(kept[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    common = ["a", "B", "the", "Zé", "漢字", "x-y", "\xa0", "10%", "'s"]
    rows = []
    for _ in range(250):
        text = "".join(rng.choices(common, weights=[9, 5, 4, 3, 2, 2, 1, 1, 1])[0] + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    rows += [("fixed phrase of words here", "en")] * 40 + [("go go go go go go go go", "fr")] * 30
    return rows + [(None, "en"), ("", None), (" . \t", "fr"), ("a " * 5000, "xx"), ("w" * 70_000 + " end", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(k % 7, t, lang, "own", 1, "own", 5) for k, (t, lang) in enumerate(rows)], DOCS).repartition(6)


def got(found):
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in names) for r in found.collect())


@pytest.mark.parametrize("plan", [{}, {"chunk": 40}, {"shares": 1 << 40}, {"chunk": 25, "shares": 1 << 40}], ids=["whole", "cut routes", "dealt", "both"])
def test_phrases(spark, rows, plan):
    assert got(collocations.collocations(frame(spark, rows), least=5, top=30, **plan)) == plain(rows, 5, 30)


def test_least_and_cover(spark, rows):
    assert got(collocations.collocations(frame(spark, rows), least=30, cover=101)) == plain(rows, 30, collocations.TOP, 101)


@pytest.mark.parametrize("small", [1, 50, 1 << 14])
def test_partitions_are_counts(monkeypatch, small):
    monkeypatch.setattr(collocations, "SMALL", max(small, 64))
    rng = np.random.default_rng(small)
    number, n = np.minimum(rng.geometric(0.4, 3000), 6), 3000
    room = np.minimum(np.arange(n, 0, -1), rng.integers(1, 7, n))

    def key(p, depth):
        return np.where(room[p] > depth, number[np.minimum(p + depth, n - 1)], -1)

    weight = rng.integers(1, 4, n)
    want, ends = collections.Counter(), collections.Counter()
    for i in range(n):
        for m in range(1, min(4, room[i]) + 1):
            want[tuple(number[i:i + m])] += weight[i]
        ends[tuple(number[i:i + min(4, room[i])])] += weight[i]
    for least in (1, 40):
        equal, last = collocations.quicksort(key, np.arange(n), weight, least)
        found = {tuple(number[p:p + m]): w for p, m, w in zip(equal.pointer, equal.words, equal.weight, strict=True)}
        assert len(found) == len(equal.pointer) and {k: w for k, w in found.items() if w >= least} == {k: w for k, w in want.items() if w >= least}
        if least == 1:
            done = collections.Counter()
            for p, m, w in zip(last.pointer, last.words, last.weight, strict=True):
                done[tuple(number[p:p + m])] += w
            assert done == ends and len(done) == len(last.pointer)


def test_products_beyond_64_bits(spark):
    rows = [("en", "a", 1, 6 * 10**15), ("en", "b", 1, 5 * 10**15), ("en", "a b", 2, 5 * 10**15)]
    found = collocations.scored(spark.createDataFrame(rows, "lang string, phrase string, words int, f long")).collect()
    assert [(r["a"], r["l"], r["r"], r["score"]) for r in found] == [(5 * 10**15, 6 * 10**15, 5 * 10**15, 2_000_000 * 5 // 11)]


def test_empty_table(spark, rows):
    assert collocations.collocations(frame(spark, rows).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [(None, None), ("", "en")])).count() == 0
