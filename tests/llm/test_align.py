"""Token alignment against a plain version over the tokenizers themselves."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import token_align
from furlong.llm.frames import documents
from furlong.llm.textblock import Block

DOCS = "doc_id long, text string, a int, pairs string, _row long, groups string"


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(token_align.vocabulary(token_align.LEFT))
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=token_align.vocabulary(token_align.RIGHT))


def plain(sides, rows):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row, token by token."""
    left, right = sides
    letters = token_align.byte_letters()
    done = []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        a = left.encode(" " + text, add_special_tokens=False).ids if text else []
        b = right.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in left.id_to_token(k)) for k in a]
        names = [right.id_to_piece(k) for k in b]
        bytes_b = [bytes([int(s[3:5], 16)]) if right.is_byte(k) else s.replace("▁", " ").encode() for k, s in zip(b, names, strict=True)]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            done.append((doc, [], [], []))
            continue
        ends = [[sum(map(len, side[:k + 1])) for k in range(len(side))] for side in (bytes_a, bytes_b)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        done.append((doc, a, b, groups))
    count = collections.Counter(p for _, _, _, groups in done for p in {(x, y) for g in groups for x in g[0] for y in g[1]})
    most = collections.Counter()
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = []
    for doc, a, b, groups in done:
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), text))
    return sorted(out, key=repr)


def got(docs, **more):
    found = token_align.counted(token_align.aligned(docs), **more)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows(spark, sf):
    rng = random.Random(13)
    scraps = ["the", " ", "  ", "\n", "\t", "don't", "DON'T", "'s", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "été", "é", "漢字カナ", "мир", "😀👍🏽", "　", "\xa0",
              "​", "\x00", "\x85", "12345", "==== ====", "a▁b", "▁", "ﬁ", "١٢٣", "x" * 40, ".,;", "ᚠ ", " "]
    made = [(k, "".join(rng.choice(scraps) for _ in range(rng.randrange(1, 25)))) for k in range(300)]
    real = [(r["doc_id"], r["text"][:1500]) for r in documents(spark, sf).filter("doc_id < 25").collect()]
    copies = [(5, real[0][1])] * 3 + [(None, real[1][1]), (None, "other text"), (None, None), (400, ""), (401, " "), (402, "\n"), (403, "word " * 4000), (404, "漢" * 500)]
    return made + real + copies


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "own", 2, "own") for i, t in rows], DOCS)


def test_all_columns(spark, sides, rows):
    assert got(frame(spark, rows)) == plain(sides, rows)


@pytest.mark.parametrize("frequent", [0, 50])
def test_rare_pairs_by_a_shuffle(spark, sides, rows, frequent):
    rows = rows[::4]
    assert got(frame(spark, rows), frequent=frequent) == plain(sides, rows)


def block_of(*texts):
    raw = [t.encode() for t in texts]
    return Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


@pytest.fixture
def aligner():
    return token_align.Aligner(token_align.ByteLevel(token_align.vocabulary(token_align.LEFT)), token_align.Pieces(token_align.vocabulary(token_align.RIGHT)))


def test_windows_are_remembered(aligner):
    aligner.block(block_of("some words here and there"))
    known = len(aligner.written), len(aligner.spelled) + 1  # the empty text is a unit without letters
    counts, written, _ = aligner.block(block_of("there and some words here and there", ""))
    assert (len(aligner.written), len(aligner.spelled)) == known and counts[0].tolist() == [7, 0] and written[1] == ""
    assert set(written[0].split(";")) <= {g for w in aligner.written for g in w.split(";")}


def test_memory_starts_anew(aligner, rows, monkeypatch):
    monkeypatch.setattr(token_align, "KNOWN", 50)
    texts = [t or "" for _, t in rows[:60]]
    whole = aligner.block(block_of(*texts))
    for k, t in enumerate(texts):
        counts, written, _ = aligner.block(block_of(t))
        assert [c[0] for c in counts] == [c[k] for c in whole[0]] and written[0] == whole[1][k]


def test_large_groups_and_equal_hashes(aligner, rows, monkeypatch):
    """The plain way for large groups, and hashes of one bit, give the same."""
    block = block_of(*[t or "" for _, t in rows[:80]])
    want = aligner.block(block)
    aligner.forget_units()
    aligner.forget_windows()
    monkeypatch.setattr(token_align, "LARGE", 1)
    real = token_align.Rolling.of
    monkeypatch.setattr(token_align.Rolling, "of", lambda self, a, b: real(self, a, b) & np.uint64(1))
    got = aligner.block(block)
    assert got[1] == want[1] and all((a == b).all() for a, b in zip([*got[0], *got[2]], [*want[0], *want[2]], strict=True))


def test_units_have_the_ids_of_whole_texts(sides, spark, sf, rows, aligner):
    texts = [r["text"] for r in documents(spark, sf).filter(F.length("text") > 0).limit(150).collect()] + [t for _, t in rows if t]
    a, text_a, b, text_b, good = aligner.encoded(block_of(*texts))
    for k, e in enumerate(sides[0].encode_batch([" " + t for t in texts], add_special_tokens=False)):
        if good[k]:
            assert a[text_a == k].tolist() == e.ids and b[text_b == k].tolist() == sides[1].encode(texts[k])
    assert good.mean() > 0.6


def test_empty_table(spark, rows):
    assert token_align.counted(token_align.aligned(frame(spark, rows).limit(0))).count() == 0
