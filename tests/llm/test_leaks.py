"""Benchmark windows in documents: the tables against a plain search, parts, odd rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import leak_scan, textblock

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, items string, hits int, n_words string, _text long"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, n=leak_scan.WINDOW):
    """Rows by comparing every place with every window."""
    tests = [(str(i) if i is not None else "", w[k:k + n]) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - n + 1))]
    out = []
    for i, t in docs:
        w = words(t)
        found = [(k, len(s), item) for item, s in tests for k in range(len(w) - len(s) + 1) if w[k:k + len(s)] == s]
        out.append((i, len(w), len({p for k, m, _ in found for p in range(k, k + m)}), tuple(sorted({item for _, _, item in found}))))
    return sorted(out, key=repr)


def got(found):
    rows = found.collect()
    for r in rows:
        ends = [(h["first"], h["last"]) for h in r["hits"]]
        assert all(a < b for a, b in ends) and all(b < c for (_, b), (c, _) in zip(ends, ends[1:], strict=False))
    return sorted(((r["doc_id"], r["n_words"], sum(h["last"] - h["first"] for h in r["hits"]), tuple(r["items"])) for r in rows), key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(12)
    vocabulary = ["a", "b", "cc", "ddd", "ÄÖ", "漢字", "x1"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "\n", "-", "'", ";"]) for _ in range(n))

    items = [(k, text(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 30]))) for k in range(40)] + [(None, text(12)), (3, text(20)), (41, None), (42, ""), (43, "A"), (44, "a")]
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    for k in range(60, 100):  # parts of items in other writing
        item = rng.choice(items)[1] or ""
        docs.append((k, text(3) + " | " + item.upper().replace(" ", "\t..") + " " + text(2)))
    docs += [(None, "cc ddd"), (None, "x1"), (7, docs[7][1]), (101, None), (102, ""), (103, "..."), (104, "ddd " * 20_000), (105, (items[8][1] or "a ") * 300)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "own", 5, "own", 1) for i, t in docs], DOCS),
            spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("own")))


def test_marks(spark, case):
    docs, items = case
    assert got(leak_scan.mark(*frames(spark, docs, items))) == plain(docs, items)


def test_parts_meet(spark, case):
    """Parts of a few kilobytes each give what one part gives."""
    docs, items = case
    docs = docs[50:]
    assert got(leak_scan.mark(*frames(spark, docs, items), part_bytes=6000)) == plain(docs, items)


def test_long_windows(spark, case):
    docs, items = case
    assert got(leak_scan.mark(*frames(spark, docs, items), n=13)) == plain(docs, items, 13)


def test_empty_tables(spark, case):
    docs, items = frames(spark, case[0], case[1])
    assert leak_scan.mark(docs.limit(0), items).count() == 0
    assert {(tuple(r["hits"]), tuple(r["items"])) for r in leak_scan.mark(docs, items.limit(0)).collect()} == {((), ())}


def test_equal_hashes_are_compared(monkeypatch):
    """With hashes of two bits every bucket holds many windows; only equal ones are found."""
    real = textblock.Rolling.of
    monkeypatch.setattr(textblock.Rolling, "of", lambda self, a, b: real(self, a, b) & np.uint64(3 << 62))
    rng = random.Random(3)
    tests = sorted({" ".join(rng.choice("abc") for _ in range(4)) for _ in range(30)})
    table = leak_scan.Windows([t.encode() for t in tests], np.arange(len(tests)), 4)
    text = [rng.choice("abc") for _ in range(400)]
    raw = " ".join(text).encode()
    first, number = table.search(leak_scan.words(textblock.Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))))
    want = {(k, tests.index(" ".join(text[k:k + 4]))) for k in range(397) if " ".join(text[k:k + 4]) in tests}
    assert set(zip(first.tolist(), number.tolist(), strict=True)) == want


def test_shifts_skip_places():
    """A text that shares no block with the windows is read once in nine words."""
    table = leak_scan.Windows([b"one two three four five six seven eight nine ten"], np.arange(1), 10)
    seen = []
    raw = ("other words " * 600).encode()
    text = leak_scan.words(textblock.Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    hashes = text.hashes
    text.hashes = lambda first, n: (seen.append(len(first)), hashes(first, n))[1]
    assert not len(table.search(text)[0]) and sum(seen) <= len(text.start) / 9 + 2 * len(text.start) / leak_scan.LANE
