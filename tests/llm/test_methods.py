"""Every operator against a brute-force version on small data, and the methods' own parts."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from furlong.llm import best_fit, frames, grouping, line_dedup, mix_histogram, near_texts, prefix_hash, rule_ensemble, simhash_trie, suffix_groups, surrogates, target_ratio, text_stats, textblock, toxicity


@pytest.fixture(scope="module")
def docs(spark, sf):
    return frames.documents(spark, sf).select("doc_id", "text", "source").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def block_of(*texts: str) -> textblock.Block:
    raw = [t.encode() for t in texts]
    return textblock.Block(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 1 toxicity
def test_blame_finds_the_sentence(spark):
    rng = random.Random(1)
    plain = [f"{rng.choice('abcdefghij')}{rng.choice('aeiou')}{rng.choice('klmnprst')}" for _ in range(60)]

    def sentence(bad=False):
        words = [rng.choice(plain) for _ in range(6)] + ["grumblefoo"] * bad
        return " ".join(words) + "."

    rows, marks = [], []
    for i in range(160):
        toxic = i % 4 == 0
        rows.append((i, " ".join(sentence(toxic and k == 3) for k in range(8))))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic", F.col("doc_id") < 120)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model, ["doc_id", "text"]).collect()}
    assert all((found[i]["score"] >= 0.5) == (y == 1) for i, y in marks)
    for i, y in marks:
        r = found[i]
        assert r["n_offending"] == y
        if y:
            assert "grumblefoo" in r["text"][r["worst_start"]:r["worst_start"] + r["worst_length"]]


def test_noisy_or_is_the_chance_of_any_sentence():
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), np.log(0.25 / 0.75))
    found, sentence, s0, s1, sdoc = toxicity.features(block_of("One two. Three! Four", ""))
    assert [("One two. Three! Four")[a:b] for a, b in zip(s0[:3], s1[:3])] == ["One two", " Three", " Four"] and sdoc.tolist() == [0, 0, 0, 1]
    z = toxicity.sentence_chances(model, found, sentence, len(s0))
    none = np.bincount(sdoc, toxicity.softplus(z))
    assert np.allclose(-np.expm1(-none), [1 - 0.75**3, 0.25])


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The sample's features never reach the driver; an empty sample gives the model without weights."""
    docs = spark.createDataFrame([(i, "fine words here. " + ("vile words there." if i % 2 else "")) for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    driver, fit = os.getpid(), toxicity.fit

    def elsewhere(bags):
        assert not bags or os.getpid() != driver
        return fit(bags)

    monkeypatch.setattr(toxicity, "fit", elsewhere)
    model = toxicity.train(docs, labels, "toxic", F.lit(True))
    assert model.weights.any() and np.isfinite(model.bias)
    none = toxicity.train(docs, labels, "toxic", F.lit(False))
    assert not none.weights.any() and none.bias == -np.inf


def test_held_out_toxicity(spark):
    path = "/root/testdata/sf0.01"
    docs, labels, apart = frames.documents(spark, path), frames.labels(spark, path), frames.held_out(0, 5)
    model = toxicity.train(docs, labels, "toxic", ~apart)
    rows = toxicity.score(docs, model, ["doc_id"]).withColumn("apart", apart).join(labels, "doc_id").filter("apart").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) >= 0.88


# ---------------------------------------------------------------- 2 surrogates
TEXT = (
    "Mrs Mary Smith wrote to Dr Ivan Petrov. SMITH said: call +1 (017) 555-7713, or (017) 555-7713; mail Und.34@mail7.example.com, UND.34@MAIL7.EXAMPLE.COM. "
    "г-жа Анна Иванова, 97.51.17.173, 4012888888881881 and 4012888888881882, token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\". Version 4.0 of 2019."
)


def test_mentions():
    found = surrogates.find(TEXT)
    assert collections.Counter(m[2] for m in found) == {
        "given_f": 2, "given_m": 1, "surname": 4, "phone": 2, "mail": 2, "address": 1, "account": 2, "key": 1}
    assert surrogates.find("Version 4.0 of 2019-01-02, 3. items; a@b no, see. Mr. x") == []


def test_people_without_titles_and_long_local_parts():
    found = surrogates.find("Anna Schmidt wrote. Later SCHMIDT met ИВАН ПЕТРОВ; Anna alone, annas.")
    assert [m[2:] for m in found] == [("given_f", "anna"), ("surname", "schmidt"), ("surname", "schmidt"), ("given_m", "иван"), ("surname", "петров"), ("given_f", "anna")]
    assert surrogates.find("anna schmidt, Annabel Lee, Anna.") == []
    local = "first." * 30 + "last"
    assert surrogates.find(f"to -{local}@mail.example.com, -@x.org and a.@x.org") == [(4, 4 + len(local) + 17, "mail", f"{local}@mail.example.com")]


def test_surrogates_keep_form():
    new, mentions, entities = surrogates.replaced(TEXT, b"k", {})
    assert (mentions, entities) == (15, 13)
    old, made = surrogates.find(TEXT), surrogates.find(new)
    assert [m[2] for m in old] == [m[2] for m in made]
    pairs = {a[2:]: b[2:] for a, b in zip(old, made, strict=True)}
    assert all(pairs[a[2:]] == b[2:] for a, b in zip(old, made, strict=True))  # one entity, one surrogate
    assert len(set(pairs.values())) == len(pairs) and not set(pairs) & set(pairs.values())
    spans = {a: (TEXT[a[0]:a[1]], new[b[0]:b[1]]) for a, b in zip(old, made, strict=True)}
    for (_, _, kind, form), (was, now) in spans.items():
        assert was.isupper() == now.isupper() or kind in ("phone", "address", "account")
        assert surrogates.script(was) == surrogates.script(now)
        if kind in ("phone", "account", "key"):
            assert re.sub(r"\w", "0", was) == re.sub(r"\w", "0", now)
        if kind == "account":
            assert (surrogates.luhn(form) == 0) == (surrogates.luhn(now) == 0)
    assert surrogates.replaced(TEXT, b"k", {})[0] == new != surrogates.replaced(TEXT, b"other", {})[0]


def test_clashes_draw_again(spark, monkeypatch):
    """With very few candidates many entities clash, with each other and with real ones; all end up apart."""

    def crowded(key, kind, form, attempt):
        return f"name{zlib.crc32(f'{form}/{attempt}'.encode()) % (60 + 30 * attempt)}"

    monkeypatch.setattr(surrogates, "candidate", crowded)
    people = [(k, 0, "surname", f"name{k}") for k in range(40)]
    found = spark.createDataFrame(people, "doc_id long, key long, kind string, form string")
    late = {r["form"]: r["attempt"] for r in surrogates.drawn_again(found, b"k").collect()}
    made = [crowded(b"k", "surname", f"name{k}", late.get(f"name{k}", 0)) for k in range(40)]
    assert len(set(made)) == 40 and not set(made) & {p[3] for p in people} and len(late) > 5


def test_no_entity_is_left(spark):
    rows = [(1, TEXT), (2, "Mr Smith, und.34@mail7.example.com again"), (3, None), (4, "nothing here")]
    got = {r["doc_id"]: r for r in surrogates.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    real = {m[2:] for _, t in rows if t for m in surrogates.find(t)}
    assert not real & {m[2:] for r in got.values() if r["text"] for m in surrogates.find(r["text"])}
    assert got[3]["text"] is None and got[4]["text"] == "nothing here" and got[4]["n_mentions"] == 0
    one, two = surrogates.find(got[1]["text"]), surrogates.find(got[2]["text"])
    assert {m[2:] for m in two} <= {m[2:] for m in one}  # the same entities have the same surrogates in both documents


# ---------------------------------------------------------------- 3 line dedup
def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def gone_lines(rows, least=5):
    lines = [(i, k, WORD.findall(line)) for i, text in sorted(rows.items()) for k, line in enumerate(text.split("\n")) if WORD.search(line)]
    return {(i, k) for n, (i, k, a) in enumerate(lines) if any(a == b or min(len(a), len(b)) >= least and edits(a, b) <= 1 for _, _, b in lines[:n])}


def test_lines_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(4)]
    bases = [[rng.choice(words) for _ in range(n)] for n in (1, 3, 4, 5, 6, 7, 16, 17, 33, 64, 65, 130)]
    rows = {}
    for i in range(40):
        lines = []
        for _ in range(4):
            line = list(rng.choice(bases))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(line) + 1)
                line[at:at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            lines.append((" \t" if rng.random() < 0.2 else " ").join(line))
        rows[i] = "\n".join(lines)
    found = line_dedup.repeated_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in found.collect()} == gone_lines(rows)


def test_kept_text(spark):
    rows = [(1, "one two three four five six\n\nshort line"), (2, "one two THREE four five six\nshort line\nshort lines\n"), (3, "one two THREE four five"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 2, 0), 2: ("short lines\n", 3, 2), 3: ("", 1, 1), 4: (None, 0, 0), 5: ("", 0, 0)}


# ---------------------------------------------------------------- 4 rules
def test_paths_of_a_forest():
    text = """RandomForestClassificationModel: uid=x
  Tree 0 (weight 1.0):
    If (feature 0 <= 10.0)
     If (feature 1 > 0.5)
      Predict: 0.0
     Else (feature 1 <= 0.5)
      Predict: 1.0
    Else (feature 0 > 10.0)
     If (feature 0 <= 20.0)
      Predict: 0.0
     Else (feature 0 > 20.0)
      Predict: 1.0
"""
    a, b = text_stats.STATISTICS[:2]
    assert {frozenset(r.bounds) for r in rule_ensemble.paths(text)} == {frozenset(x) for x in (
        {(a, False, 10.0)}, {(a, False, 10.0), (b, True, 0.5)}, {(a, False, 10.0), (b, False, 0.5)}, {(a, True, 10.0)}, {(a, False, 20.0), (a, True, 10.0)}, {(a, True, 20.0)})}


def test_compiled_rules_are_the_ensemble(spark):
    rules = [(rule_ensemble.Rule((("n_words", True, 3.0),)), 1.5), (rule_ensemble.Rule((("mean_word", False, 2.0), ("n_words", False, 9.0))), -2.0)]
    rows = [tuple(float(x) for x in (n, m, *[0] * 16)) for n in (2, 5, 10) for m in (1, 3)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in text_stats.STATISTICS))
    got = [r["s"] for r in df.select(rule_ensemble.Ensemble(0.3, rules).score().alias("s")).collect()]
    assert np.allclose(got, [1 / (1 + np.exp(-(0.3 + 1.5 * (n > 3) - 2.0 * (m <= 2 and n <= 9)))) for n in (2, 5, 10) for m in (1, 3)])


def test_held_out_quality(spark):
    path = "/root/testdata/sf0.01"
    labels, apart = frames.labels(spark, path), frames.held_out(2, 4)
    stats = frames.stored(rule_ensemble.with_statistics(frames.documents(spark, path)), "statistics")
    model = rule_ensemble.fit(stats, labels, "quality", ~apart)
    rows = stats.select("doc_id", model.score().alias("score")).withColumn("apart", apart).join(labels, "doc_id").filter("apart").collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) >= 0.97


# ---------------------------------------------------------------- 5 repeated strings
def test_suffix_order_is_the_sorted_order():
    rng = random.Random(5)
    for _ in range(400):
        values = [rng.randint(1, rng.choice((1, 2, 3, 9))) for _ in range(rng.randrange(60))] + [0]
        assert grouping.suffix_order(np.array(values)).tolist() == sorted(range(len(values)), key=lambda i: values[i:])


def without_strings(rows, length=200):
    raw = [(i, (t or "").encode()) for i, t in rows]
    starts = collections.Counter(b[k:k + length] for _, b in raw for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)

    def noise(n):
        return "".join(rng.choice("abc é") for _ in range(n))

    shared = [noise(n) for n in (199, 200, 201, 400, 900)]
    rows = []
    for i in range(40):
        text = "".join(noise(rng.randrange(80)) + rng.choice(shared)[rng.randrange(3):] for _ in range(rng.randrange(4)))
        if text and rng.random() < 0.5:
            at = rng.randrange(len(text))
            text = text[:at] + "Z" + text[at + 1:]
        rows.append((i, text))
    return rows + [(100, "a" * 700), (101, "ab" * 300), (102, None), (103, ""), (104, "b" * 199), (105, rows[3][1]), (105, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("crowded", [False, True])
def test_strings_against_all_strings(spark, monkeypatch, seed, crowded):
    """Both ways: suffix orders of whole groups, and strings counted over the cluster."""
    monkeypatch.setattr(suffix_groups, "GROUP", 0 if crowded else suffix_groups.GROUP)
    rows = passages(seed)
    got = suffix_groups.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got)) == without_strings(rows)


def test_long_texts_are_cut_into_stretches(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 9000).astype(np.uint8)
    whole = suffix_groups.anchors(textblock.Block(data, np.array([0, len(data)])))
    monkeypatch.setattr(suffix_groups, "_PLACE", np.uint64((1 << 12) - 1))
    cut = suffix_groups._long(textblock.Block(data, np.array([0, len(data)])))
    for found in (whole, cut):  # each string is owned once
        owned = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(found[1], found[2])])
        assert sorted(owned.tolist()) == list(range(len(data) - suffix_groups.LENGTH + 1))


# ---------------------------------------------------------------- 6 ratio
def base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k:k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, docs, texts, odd):
    ratios = np.zeros(target_ratio.BUCKETS)
    for table in (docs, odd):
        want = collections.Counter((r["doc_id"], *base(r["text"])) for r in table.collect())
        got = collections.Counter((r["doc_id"], *[r[c] for c in target_ratio.COUNTS]) for r in target_ratio.judge(table, ratios, ["doc_id"]).collect())
        assert got == want


def test_ratio_prefers_the_trusted(spark):
    rng = random.Random(6)
    good, bad = [f"g{k}" for k in range(50)], [f"b{k}" for k in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(80))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratios = target_ratio.count(docs, docs.filter("doc_id % 2 = 1 and doc_id < 100"))
    found = {r["doc_id"]: r for r in target_ratio.judge(docs, ratios, ["doc_id"], -0.05).collect()}
    assert min(found[i]["score"] for i, _ in rows if i % 2) > max(found[i]["score"] for i, _ in rows if not i % 2)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= -0.05) for r in found.values())
    # by hand: the mean of the log ratios of the words and pairs
    block = block_of(rows[1][1])
    buckets, _ = target_ratio.buckets(text_stats.Words(block))
    assert len(buckets) == 159 and np.isclose(found[1]["score"], ratios[buckets].mean())


def test_fits_do_not_depend_on_the_order_of_repeated_ids(spark):
    rng = random.Random(4)
    rows = [(i % 60, " ".join(rng.choice(("alpha", "beta", "gamma" if i % 2 else "delta")) for _ in range(5 + i % 40)) + ".") for i in range(180)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, y int")
    models, rules = [], []
    for table in (rows, rows[::-1]):
        docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
        models.append(toxicity.train(docs, marks, "y", F.lit(True)))
        rules.append(rule_ensemble.fit(rule_ensemble.with_statistics(docs), marks, "y", F.lit(True)))
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    assert rules[0] == rules[1]


# ---------------------------------------------------------------- 7 fingerprints
def test_edited_texts(docs, texts):
    got = {r["doc_id"]: r for r in prefix_hash.compare(docs).collect()}
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
    for a, b in itertools.combinations(order[:60], 2):
        assert (got[a]["fingerprint"] == got[b]["fingerprint"]) == (texts[a] == texts[b])
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.4 > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_hot_ids_are_cut(spark):
    """Half of the ids null, a quarter one id: no stretch holds much more than others, and every row meets the next of the order."""
    rng = random.Random(77)
    rows = [(None if i % 2 else 7 if i % 4 else rng.randrange(-50, 60), f"text {i % 1900} " + "ab é😀"[i % 5] * (i % 9)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("key", frames.text_key())
    order = sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["key"]))
    want = collections.Counter()
    for k, r in enumerate(order):
        text, after, third = r["text"], order[(k + 1) % len(order)]["text"], len(r["text"]) // 3
        want[r["doc_id"], len(text), hashlib.sha256((text[:len(text) - third] + after[:third]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in prefix_hash.compare(docs).collect()) == want
    sizes = [r["count"] for r in prefix_hash.in_order(docs).filter("guest = 0").groupBy("stretch").count().collect()]
    mean = len(rows) / prefix_hash.STRETCHES / int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(sizes) == len(rows) and max(sizes) <= 2.5 * mean + 20


def test_spans_and_extensions():
    rng = np.random.default_rng(7)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    prefixes, raw = prefix_hash.Prefixes(data), data.tobytes()
    a, b, n = rng.integers(0, 500, 300), rng.integers(0, 500, 300), rng.integers(0, 12, 300)
    assert (prefixes.same(a, b, n) == [raw[x:x + m] == raw[y:y + m] for x, y, m in zip(a, b, n)]).all()
    most = 600 - np.maximum(a, b)
    want = [next((k for k in range(m) if raw[x + k] != raw[y + k]), m) for x, y, m in zip(a, b, most)]
    assert prefix_hash.extension(prefixes, a, b, most).tolist() == want


def test_sketch_is_the_smallest_span_hashes(texts):
    block = block_of(*[t for t in texts.values()][:20], "ab" * 400)
    prefixes = prefix_hash.Prefixes(block.data)
    for k, sketch in enumerate(prefix_hash.sketches(prefixes, block.off)):
        width = min(prefix_hash.SPAN, int(block.off[k + 1] - block.off[k]))  # a short text is one span
        starts = np.arange(block.off[k], block.off[k + 1] - width + 1)
        every = np.unique(textblock.mixed(prefixes.hashes(starts, starts + width)))
        assert sketch.tolist() == every[:prefix_hash.SKETCH].tolist()


# ---------------------------------------------------------------- 8 packing
def test_pieces_are_the_tokens(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(best_fit.vocabulary())
    got = collections.defaultdict(list)
    for r in best_fit.pack(docs).collect():
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        cut = [ids[k:k + 2048] for k in range(0, len(ids), 2048)]
        assert sorted(got[i]) == [(k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(cut)]


def test_sequences_are_full_and_gapless(docs):
    found = collections.defaultdict(list)
    total = 0
    for r in best_fit.pack(docs).collect():
        found[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    for parts in found.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(found) <= 1.03 * -(-total // 2048) + 1


@pytest.mark.parametrize("counts", [{}, {1: 5}, {2048: 3}, {1025: 4, 1023: 4}, {700: 10, 600: 10, 48: 30}, {1: 5000, 2047: 10}, {k: k % 7 for k in range(1, 2049)}])
def test_rounds_place_every_rank_once(counts):
    runs = best_fit.rounds(counts)
    ranks = {length: sorted((first, n) for size, first, n, _, _ in runs if size == length) for length in counts}
    for length, parts in ranks.items():
        at = 0
        for first, n in parts:
            assert first == at
            at += n
        assert at == counts[length]
    cells = collections.Counter()
    for length, _, n, first, offset in runs:
        for s in range(first, first + n):
            assert cells[s] == offset
            cells[s] += length
    assert all(v <= 2048 for v in cells.values())
    assert len(cells) <= max(-(-sum(k * n for k, n in counts.items()) // 2048) * 1.02 + 1, sum(n for k, n in counts.items() if k > 1024))


# ---------------------------------------------------------------- 9 simhash
def print_of(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, odd):
    for table in (docs, odd):
        want = collections.Counter((r["doc_id"], print_of(r["text"])) for r in table.collect())
        assert collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1) for r in simhash_trie.fingerprints(table).collect()) == want


@pytest.mark.parametrize("group", [4096, 8])
def test_links_against_all_pairs(spark, group):
    """Also with groups so small that node pairs are opened over the cluster."""
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for c in centres for _ in range(25)} | {0, 1, (1 << 64) - 1}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    found = simhash_trie.links(spark.createDataFrame([(v,) for v in signed.values()], "fp long"), group=group).collect()
    want = {frozenset((signed[a], signed[b])) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 2}
    assert {frozenset((r["a"], r["b"])) for r in found} == want and len(found) == len(want)


def test_repeats_of_the_shared_fingerprints_stay_off_the_driver(spark, documents):
    """The table that is repeated for every salt is merged, however small Spark takes its files for, so the driver never collects the repeats."""
    table = documents([(i, f"some words of text number {i % 7}", "a") for i in range(40)])
    plan = simhash_trie.groups(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    left, right = spark.range(20).selectExpr("id % 3 as k", "id"), spark.createDataFrame([(0, "x"), (1, "y")], "k long, v string")
    got = [sorted(map(tuple, frames.salted_join(left, right, ["k"], "left", merged=m).collect())) for m in (False, True)]
    assert got[0] == got[1] and len(got[0]) == 20


def test_components_of_a_chain(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    values = spark.createDataFrame([(k, 1000 - k) for k in [*range(41), 100, 101]], "vertex long, value long")
    got = {r["vertex"]: r["label"] for r in simhash_trie.components(pairs, values).collect()}
    assert got == {**{k: 960 for k in range(41)}, 100: 899, 101: 899}


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (2, "x y z"), (7, ""), (6, None), (None, " "), (2, "x y z"), (9, "q r s t u")]
    got = sorted((r["doc_id"], r["text"]) for r in simhash_trie.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, "A b c d"), (2, "x y z"), (6, None), (9, "q r s t u")]


def test_near_texts_against_all_pairs(spark):
    """The stage of the pipeline keeps one of every group that five-word similarities of 0.8 or more link."""
    rng = random.Random(5)
    rows = [(900, "one two three"), (901, "One two  three"), (902, "one two four"), (903, ""), (904, None), (905, "one two three four five"), (906, "one two three four five")]
    for i in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((9, 40, 90, 200)))]
        for k in range(rng.randrange(1, 6)):
            rows.append((10 * i + k, " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}
    first = {i: i for i in sets}
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in near:
            first[a] = first[b] = min(first[a], first[b])
    assert 30 < len(near) and any(len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b]) for a, b in near)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(i for i in first if first[i] == i)


def shingle_sets(rows):
    words = {i: t.split() for i, t in rows}
    return {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}


def pairs_met(spark, rows):
    """Pairs of texts that are compared if nothing is linked yet, and the texts' vertices by number."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = frames.stored(near_texts.prefixes(docs, near_texts.bucket_rows(docs)), "prefixes")
    members = frames.stored(near_texts.members_of(marked), "members")
    found = near_texts.central_pairs(members).unionByName(near_texts.apart_pairs(members.withColumn("label", F.struct("vertex")))).distinct()
    return {(r["a"], r["b"]) for r in found.collect()}, {r["doc_id"]: r["vertex"] for r in marked.collect()}


def test_pages_of_one_template_meet_nowhere(spark):
    """Pages whose own words, an eighth to a fifth, come before, after or around the common ones, and whose sizes differ a little."""
    rng = random.Random(21)
    template, rows = [f"t{k}" for k in range(300)], []
    for i in range(240):
        own = [f"o{i}x{k}" for k in range(rng.randrange(44, 76))]
        at = rng.choice((0, len(own), 20))
        rows.append((i, " ".join(own[:at] + template + own[at:])))
    sets = shingle_sets(rows)
    assert not any(5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2))
    met, _ = pairs_met(spark, rows)
    assert len(met) <= len(rows)  # of 28,680


def test_no_alike_pair_is_missed(spark):
    """By band of similarity: every pair of planted copies of 0.8 and more is among those compared, at all lengths and with many edits."""
    rng, rows = random.Random(22), []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((6, 30, 120, 400)))]
        for k in range(5):
            copy = list(words) + [f"e{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1 + len(words) // 6))]
            for _ in range(rng.randrange(1 + len(words) // 60)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10 ** 6)}"
            rows.append((10 * g + k, " ".join(copy)))
    sets = shingle_sets(rows)
    met, vertex = pairs_met(spark, rows)
    bands = collections.Counter()
    for a, b in itertools.combinations(sets, 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * all_ and vertex[a] != vertex[b]:
            bands[20 * both // all_] += 1
            assert (min(vertex[a], vertex[b]), max(vertex[a], vertex[b])) in met
    assert all(bands[k] >= 5 for k in (16, 17, 18, 19))


# ---------------------------------------------------------------- 10 mixing
def level(sizes, weights=(5, 2, 1)):
    """Targets by cutting and sharing again until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**target, **share}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_targets_and_takes(spark):
    rng = random.Random(10)
    rows = [(i, "w " * rng.choice((1, 5, 40, 200)), rng.choice(["a", "b", "B", "é", "", None, *["z"] * 6])) for i in range(600)]
    got = mix_histogram.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = level(sizes), collections.Counter()
    for r in got:
        assert r["_source_size"] == sizes[r["source"]] and np.isclose(r["_target"], want[r["source"]]) and 0 <= r["_copies"] <= 2
        taken[r["source"]] += r["_copies"] * r["_size"]
    assert all(abs(taken[s] - want[s]) <= 100 for s in want)  # half the largest document


def test_thresholds_are_nested(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")
    few, many = ({r["doc_id"]: r["_copies"] for r in mix_histogram.mix(docs, share=s).collect()} for s in (0.6, 0.9))
    assert all(few[i] <= many[i] for i in few) and sum(few.values()) < sum(many.values())


def test_near_texts_come_from_fingerprints_first(spark):
    """The fingerprints are majorities of bits, their pairs are those of the trie join, and the pipeline's stage asks for them."""
    import inspect

    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "x"]), " ".join(reversed(words)), "a b", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marked = frames.stored(near_texts.prefixes(docs, near_texts.bucket_rows(docs)), "prefixes")
    prints = {r["doc_id"]: r for r in marked.collect()}
    block = next(iter(textblock.blocks(docs.toArrow().combine_chunks().to_batches()[0], "text")))[1]
    _, doc, codes = near_texts.shingles(block)
    for i in range(len(texts)):
        own = [int(c) for c in codes[doc == i]]
        assert prints[i]["fp"] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in own) > len(own))
    found = {(r["a"], r["b"]) for r in near_texts.print_pairs(marked, 3).collect()}
    far = (prints[0]["fp"] ^ prints[1]["fp"]) & (2**64 - 1)
    pair = tuple(sorted((prints[0]["vertex"], prints[1]["vertex"])))
    assert far.bit_count() <= 3 and found == {pair}
    assert "print_pairs(" in inspect.getsource(near_texts.labelled)
