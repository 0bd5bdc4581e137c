"""Surrogates for personal data.

Mentions of people, mail addresses, telephone numbers, network addresses, account numbers and access keys are found in whole
texts and replaced by made-up ones of the same type: names keep gender, script and letter case, numbers their length, punctuation, leading
digit or country code and the validity of their check digit, mail addresses their top-level domain.  A surrogate is a function of a secret key, the
type and the entity's normal form, so an entity has one surrogate in all documents and spellings (coreference), also where
only a part of a name is repeated later in a document.

Different entities keep different surrogates, and no surrogate is an entity of the corpus: after all entities are known, candidates are
checked against entities, accepted surrogates and each other; of those that clash the first keeps its candidate and the others draw
again, until none clash.  Only entities that drew again are looked up when texts are rewritten; all others follow from the key.

Defined results: a null text stays null, an empty one empty; texts without mentions are returned as they are; repeated rows are rewritten alike.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.llm.frames import salted_join, shielded, stored, text_key

KEY = b"change me for every release"
TYPES = ["mail", "phone", "address", "account", "key", "given_f", "given_m", "surname"]
#: From this draw on a candidate may be longer than its entity, so that short ones never run out.
LONGER = 6

# Titles by gender, given names of known gender, and syllables by script.
TITLES_M = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "г-н", "Κύριος"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "Κυρία"]
TITLES_N = ["Dr", "Prof"]
GIVEN_F = "anna marie mary elizabeth ines carmen sophie julia ruth karin agnes astrid мария анна ольга нина ελένη μαρία".split()
GIVEN_M = "john james peter hans karl jean pierre luca sasha jose andrea nikita илья никита иван пётр γιώργος νίκος".split()
SYLLABLES = {
    "latin": ["ba", "be", "bri", "ca", "co", "da", "del", "fa", "fer", "ga", "gre", "ha", "hol", "ja", "ka", "kel", "la", "lin", "ma", "mo", "na", "nor", "pa", "ra", "ros", "sa", "ste", "ta", "tor", "va", "wel"],
    "cyrillic": ["ба", "ве", "га", "до", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "ни", "по", "ра", "ро", "са", "се", "та", "ти"],
    "greek": ["βα", "γα", "δη", "θα", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νι", "πα", "ρα", "ρο", "σα", "στε", "τα", "τι", "φι"],
}
ENDINGS = {
    ("latin", "given_f"): ["na", "ria", "lia", "ine"], ("latin", "given_m"): ["nas", "ton", "rik", "old"], ("latin", "surname"): ["son", "man", "ley", "berg"],
    ("cyrillic", "given_f"): ["на", "ия", "ла", "ра"], ("cyrillic", "given_m"): ["слав", "мир", "ей", "ан"], ("cyrillic", "surname"): ["ов", "ин", "ев", "ский"],
    ("greek", "given_f"): ["να", "ια", "νη", "ρα"], ("greek", "given_m"): ["ος", "ης", "ας", "ων"], ("greek", "surname"): ["ίδης", "άκης", "όπουλος", "άτος"],
}

_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_DIGIT = re.compile(r"\d")
_NUMBERS = re.compile(
    r"(?P<key>(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z]))"
    r"|(?P<address>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))"
    r"|(?P<account>(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{4})(?!\d))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{8,15}(?!\d)|(?:\+\d{1,3}[ .-]?\(?|\()\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)))"
)
_CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ"
_PERSON = re.compile(
    rf"(?<!\w)(?:(?P<m>{'|'.join(TITLES_M)})|(?P<f>{'|'.join(TITLES_F)})|{'|'.join(TITLES_N)})\.?\s+"
    rf"(?P<name>[{_CAPITAL}][^\W\d_]+(?:[ -][{_CAPITAL}][^\W\d_]+){{0,2}})")
_KNOWN = re.compile(
    rf"(?<!\w)(?P<name>(?:{'|'.join(w for n in [*GIVEN_F, *GIVEN_M] for w in (n.capitalize(), n.upper()))})(?:[ -][{_CAPITAL}][^\W\d_]+){{1,2}})")
_TITLED = re.compile("|".join([*TITLES_M, *TITLES_F, *TITLES_N]))


def script(word: str) -> str:
    first = ord(word[0])
    return "greek" if 0x370 <= first < 0x400 or 0x1F00 <= first < 0x2000 else "cyrillic" if 0x400 <= first < 0x530 else "latin"


def given_type(word: str, title: str) -> str:
    """By the title, else by known names, else by the ending."""
    low = word.lower()
    if title:
        return f"given_{title}"
    if low in GIVEN_F or low in GIVEN_M:
        return "given_f" if low in GIVEN_F else "given_m"
    return "given_f" if low[-1] in "aаяηα" else "given_m"


def _local_start(text: str, at: int) -> int:
    """Where the local part that ends at ``at`` starts; ``at`` if there is none."""
    if not at or text[at - 1] not in _ALNUM:
        return at
    start = at
    while start and text[start - 1] in _LOCAL:
        start -= 1
    while text[start] not in _ALNUM:
        start += 1
    return start


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normal form) of all mentions, in order and apart from each other."""
    found: list[tuple[int, int, str, str]] = []
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and (start := _local_start(text, at)) < at:
            found.append((start, domain.end(), "mail", text[start:domain.end()].lower()))
        at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _NUMBERS.finditer(text):
            kind = m.lastgroup if m.lastgroup != "gap" else "account"
            bare = m.group() if kind == "address" else "".join(c for c in m.group().lower() if c.isalnum())
            found.append((m.start(), m.end(), kind, ("+" if m.group()[0] == "+" else "") + bare))
    people = [(m["name"], "m" if m["m"] else "f" if m["f"] else "") for m in _PERSON.finditer(text)] if _TITLED.search(text) else []
    people += [(m["name"], "") for m in _KNOWN.finditer(text)]  # a known given name needs no title
    if people:
        tokens: dict[str, str] = {}
        for name, title in people:
            words = re.split(r"[ -]", name)
            for k, word in enumerate(words):
                kind = given_type(word, title) if k == 0 and len(words) > 1 else "surname"
                for spelling in (word, word.upper()):
                    tokens.setdefault(spelling, kind)
        # parts of a name that stand elsewhere in the document belong to it
        either = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(tokens, key=len, reverse=True)))})(?!\w)")
        found += [(m.start(), m.end(), tokens[m.group()], m.group().lower()) for m in either.finditer(text)]
    found.sort()
    apart: list[tuple[int, int, str, str]] = []
    for mention in found:
        if not apart or mention[0] >= apart[-1][1]:
            apart.append(mention)
    return apart


class Draw:
    """A stream of small numbers from the key, the type, the normal form and the number of the draw."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.name, self.block, self.left = key, "\x1f".join(map(str, parts)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.name + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the same kind; others stay."""
        if c.isdigit():
            return str(self.below(10))
        return "abcdefghijklmnopqrstuvwxyz"[self.below(26)] if "a" <= c <= "z" else c


def luhn(digits: str) -> int:
    """Check sum: 0 for a valid number."""
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10


def candidate(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The surrogate's normal form at a draw."""
    draw = Draw(key, kind, form, attempt)
    if kind == "mail":
        local, _, domain = form.partition("@")
        labels = domain.split(".")
        whole = Draw(key, "domain", domain)  # one domain, one surrogate
        more = "".join(str(draw.below(10)) for _ in range(max(0, attempt - LONGER)))
        return "".join(map(draw.like, local)) + more + "@" + ".".join(["".join(map(whole.like, x)) for x in labels[:-1]] + labels[-1:])
    if kind == "address":
        first = int(form.split(".")[0])
        lead = first if first in (10, 127, 169, 172, 192) or attempt < LONGER and first >= 224 else 1 + draw.below(223)
        return ".".join(map(str, [lead, draw.below(256), draw.below(256), 1 + draw.below(254)]))
    if kind == "phone":
        fixed = (2 if form[1:2] in "17" else 3) if form[0] == "+" else 0
        return form[:fixed] + "".join(map(draw.like, form[fixed:]))
    if kind == "account":
        body = form[0] + "".join(map(draw.like, form[1:-1]))
        right = -luhn(body + "0") % 10
        return body + str(right if luhn(form) == 0 else (right + 1 + draw.below(9)) % 10)
    if kind == "key":
        return "".join("0123456789abcdef"[draw.below(16)] for _ in form)
    writing = script(form)
    syllables, endings = SYLLABLES[writing], ENDINGS[writing, kind]
    ending = endings[draw.below(len(endings))]
    if kind == "surname" and writing == "cyrillic" and form[-1] in "ая":
        ending = {"ский": "ская"}.get(ending, ending + "а")
    return "".join(syllables[draw.below(len(syllables))] for _ in range(2 + min(2, len(form) // 4) + attempt // LONGER)) + ending


def written(mention: str, kind: str, form: str) -> str:
    """The surrogate's normal form in the spelling of the mention it replaces."""
    if kind in ("phone", "account", "key"):
        left = iter((form.upper() if mention.upper() == mention else form).lstrip("+"))
        return "".join(next(left) if c.isalnum() else c for c in mention)
    if kind == "address":
        return form
    if mention.isupper() and len(mention) > 1:
        return form.upper()
    return form[0].upper() + form[1:] if mention[0].isupper() else form


def replaced(text: str, key: bytes, again: dict[tuple[str, str], int]) -> tuple[str, int, int]:
    """The text with surrogates, the number of mentions and of different entities."""
    mentions = find(text)
    parts, at = [], 0
    for start, end, kind, form in mentions:
        parts += [text[at:start], written(text[start:end], kind, candidate(key, kind, form, again.get((kind, form), 0)))]
        at = end
    return "".join([*parts, text[at:]]), len(mentions), len({m[2:] for m in mentions})


# ---------------------------------------------------------------- over the corpus
def entities(rows: DataFrame) -> DataFrame:
    """(doc_id, key, kind, form) of the different entities of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, forms = [], [], []
            for k, text in enumerate(batch.column("text")):
                for kind, form in dict.fromkeys(m[2:] for m in find(text.as_py() or "")):
                    at.append(k)
                    kinds.append(kind)
                    forms.append(form)
            own = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(own), batch.column("key").take(own), pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["doc_id", "key", "kind", "form"])

    return rows.select("doc_id", "key", "text").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, key long, kind string, form string")


def _space() -> Column:
    """Names of all kinds must differ from each other; other types only among themselves."""
    return F.when(F.col("kind").isin("given_f", "given_m", "surname"), F.lit("name")).otherwise(F.col("kind"))


def drawn_again(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt) of the entities whose first candidate clashed, with the draw that did not."""

    def run(attempt: int):
        def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, forms = batch.column("kind").to_pylist(), batch.column("form").to_pylist()
                made = [candidate(key, k, f, attempt) for k, f in zip(kinds, forms, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], [*batch.schema.names, "made"])

        return candidates

    known = stored(found.select("kind", "form").distinct().withColumn("space", _space()), "entities")
    waiting, accepted, late, attempt = known, None, None, 0
    while True:
        made = stored(waiting.mapInArrow(run(attempt), "kind string, form string, space string, made string"), "candidates")
        real = known.select(F.col("space").alias("_space"), F.col("form").alias("made")).distinct()
        free = made.join(real, (F.col("space") == F.col("_space")) & (made["made"] == real["made"]), "left_anti")
        if accepted is not None:
            free = free.join(accepted, ["space", "made"], "left_anti")
        first = free.groupBy("space", "made").agg(F.min(F.struct("kind", "form")).alias("_first"))
        won = stored(first.select("space", "made", F.col("_first.kind").alias("kind"), F.col("_first.form").alias("form")), "accepted")
        accepted = won.select("space", "made") if accepted is None else accepted.unionByName(won.select("space", "made"))
        if attempt:
            now = won.select("kind", "form", F.lit(attempt).alias("attempt"))
            late = now if late is None else late.unionByName(now)
        waiting = stored(made.select("kind", "form", "space").join(won, ["kind", "form"], "left_anti"), "waiting")
        if waiting.isEmpty():
            return late if late is not None else known.limit(0).select("kind", "form", F.lit(0).alias("attempt"))
        attempt += 1


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus n_mentions and n_entities."""
    return shielded(docs, lambda d: _rewritten(d, key), ("n_mentions", "n_entities"))


def _rewritten(docs: DataFrame, key: bytes) -> DataFrame:
    rows = docs.withColumn("_key", text_key())
    found = stored(entities(docs.select("doc_id", text_key().alias("key"), "text")), "mentions")
    late = stored(drawn_again(found, key), "late")
    by_text = salted_join(found, late, ["kind", "form"], "inner").groupBy("doc_id", "key").agg(F.collect_set(F.struct("kind", "form", "attempt")).alias("_again"))  # entities of one text
    by_text = by_text.withColumnsRenamed({"doc_id": "_late_doc", "key": "_late_key"})
    met = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("_late_doc")) & (F.col("_key") == F.col("_late_key")), "left")
    met = met.select(*docs.columns, "_again")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, mentions, distinct = [], [], []
            for text, again in zip(batch.column("text"), batch.column("_again"), strict=True):
                if (raw := text.as_py()) is None:
                    result = (None, 0, 0)
                else:
                    result = replaced(raw, key, {(a["kind"], a["form"]): a["attempt"] for a in again.as_py() or ()})
                for out, value in zip((texts, mentions, distinct), result, strict=True):
                    out.append(value)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(mentions, pa.int64()), pa.array(distinct, pa.int64())], [*batch.schema.names[:-1], "n_mentions", "n_entities"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_mentions", T.LongType()), T.StructField("n_entities", T.LongType())])
    return met.mapInArrow(run, schema)
