"""Operator 9, secret scans with a random forest against false positives.

Patterns find candidates: unbroken runs that mix letters and digits, and
whatever is assigned to a credential's name.  A forest trained from labelled
findings decides, by the candidate's length and character transitions, how
much of it the other words of the document and the corpus's common words
cover, and its path and neighbours.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import bytes_of, in_slices, written

#: Names that announce a credential, as they stand before a value.
NAMES = (b"password", b"passwd", b"pwd", b"secret", b"token", b"api_key", b"apikey", b"access_key", b"auth", b"credential", b"private_key")
#: Beginnings of issued keys.
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"xoxb-", b"xoxp-", b"sk_live_", b"sk-", b"AIza", b"eyJ", b"glpat-")
_RUN = re.compile(rb"(?:" + b"|".join(PREFIXES) + rb")[A-Za-z0-9_\-.]{10,}|(?=[A-Za-z0-9_\-+/=.:@]*[0-9])[A-Za-z0-9_\-+/=.:@]{10,}|(?<=[=:\"'])[A-Za-z0-9_\-+/.!@#$%^&*]{6,}")
#: What a credential's name announces, of any characters, up to a white space,
#: a quote or the next parameter of a query string.
_NAMED = re.compile(rb"(?:" + b"|".join(NAMES) + rb")[A-Za-z_]{0,12}[\"']?\s{0,2}[=:]+\s{0,2}[\"']?((?:(?!&[A-Za-z_]+=)[^\s\"'])+)", re.I)
#: The password of an address, between its user and its host.
_ADDRESS = re.compile(rb"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s:/@\"']{1,200}:([^\s@/\"']{3,})@")
_IN_ADDRESS = re.compile(rb"://[^\s:/@\"']{1,200}:$")
_WORD = re.compile(rb"[A-Za-z]{3,}")
_VALUE = re.compile(rb"^[A-Za-z_\-]{2,30}[=:]+[\"']?")
_ASSIGNED = re.compile(rb"(?:" + b"|".join(NAMES) + rb")[A-Za-z_]{0,12}[\"']?\s{0,2}[=:]+\s{0,2}[\"']?$", re.I)
FEATURES = ("length", "entropy", "digits", "uppers", "lowers", "others", "transitions", "letter_digit", "hex_only", "digit_only", "covered", "common", "prefix", "assigned", "name_near", "dots", "at_sign", "test_path")
_TEST_PATH = re.compile(rb"test|example|sample|mock|doc", re.I)


def candidates(text: bytes) -> Iterator[tuple[int, int]]:
    """(begin, end) of the values worth judging, in bytes, left to right.

    A run that holds a named value and more before it comes beside that value;
    the password of an address is a value of its own.
    """
    named = [m.span(1) for m in _ADDRESS.finditer(text)]
    for m in _NAMED.finditer(text):
        begin, end = _trimmed(text, *m.span(1))
        if end - begin >= 6 and not _ADDRESS.search(text, begin, end + 1):
            named.append((begin, end))
    named = sorted(set(named))
    spans, i = list(named), 0
    for m in _RUN.finditer(text):
        begin, end = _trimmed(text, *m.span())
        if v := _VALUE.match(text[begin:end]):
            begin += v.end()
        while i < len(named) and named[i][1] <= begin:
            i += 1
        # a run that begins within a named value is a part of it
        if end - begin >= 6 and not (i < len(named) and named[i][0] <= begin) and not _ADDRESS.search(text, begin, end + 1):
            spans.append((begin, end))
    yield from sorted(spans)


def _trimmed(text: bytes, begin: int, end: int) -> tuple[int, int]:
    while end > begin and text[end - 1] in b".:=,":
        end -= 1
    return begin, end


def prose(text: bytes, spans: list[tuple[int, int]]) -> set[bytes]:
    """Runs of letters of a text outside its candidates, lower-cased: no
    candidate covers itself, however often it stands in the text."""
    outside, at = [], 0
    for begin, end in sorted(spans):
        outside.append(text[at : max(at, begin)])
        at = max(at, end)
    return {w.lower() for w in _WORD.findall(b" ".join([*outside, text[at:]]))}


def features(text: bytes, begin: int, end: int, words: set[bytes], common: frozenset[bytes], path: bytes) -> list[float]:
    """``words``: those of the text's ``prose``; ``common``: those of the corpus."""
    value = text[begin:end]
    n = len(value)
    kinds = [0 if 48 <= c < 58 else 1 if 65 <= c < 91 else 2 if 97 <= c < 123 else 3 for c in value]
    count = Counter(kinds)
    steps = Counter((a, b) for a, b in zip(kinds, kinds[1:]) if a != b)
    near = text[max(0, begin - 40) : begin]
    runs = _WORD.findall(value)
    covered = sum(len(r) for r in runs if r.lower() in words) / n
    known = sum(len(r) for r in runs if r.lower() in common) / n
    low = near.lower()
    return [
        float(n),
        -sum(v / n * math.log2(v / n) for v in Counter(value).values()),
        count[0] / n,
        count[1] / n,
        count[2] / n,
        count[3] / n,
        sum(steps.values()) / max(1, n - 1),
        (steps[0, 1] + steps[1, 0] + steps[0, 2] + steps[2, 0]) / max(1, n - 1),
        float(all(c in b"0123456789abcdefABCDEF" for c in value)),
        float(count[0] == n),
        covered,
        known,
        float(value.startswith(PREFIXES)),
        float(bool(_ASSIGNED.search(near) or _IN_ADDRESS.search(text[max(0, begin - 220) : begin]))),
        float(any(x in low for x in NAMES)),
        value.count(b".") / n,
        float(b"@" in value),
        float(bool(_TEST_PATH.search(path))),
    ]


#: How many forms of secrets the seeded findings have.
FORMS = 12


def labelled_findings(n: int = 3000, seed: int = 9, forms: tuple[int, ...] = tuple(range(FORMS))) -> list[tuple[str, str, str, str, int]]:
    """A seeded set of findings: (before, value, after, path, label).

    Used where no labelled findings of one's own are given.  Half are secrets
    in the forms that issuers use and people make up (those of ``forms``), half
    what scanners mistake for them.
    """
    rng = random.Random(seed)
    up, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    both = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    syllables = ["the", "on", "er", "ing", "tion", "re", "an", "ha", "st", "ou", "and", "le", "is"]
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    made = lambda: "".join(pick("bcdfghjklmnprstvwz", 1) + pick("aeiou", 1) + pick("bdfgklmnprst", rng.randint(0, 1)) for _ in range(rng.randint(2, 3)))
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    say = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    name = lambda: rng.choice(NAMES).decode()
    rows = []
    for i in range(n):
        before, after, path = say() + " ", " " + say(), rng.choice(["", "src0", "app/config", "docs/example", "tests/data"])
        if i % 2:
            form = forms[rng.randrange(len(forms))]
            if form == 9:
                # what people make up: two or three words that the text has not, perhaps with figures
                value, before = "".join(rng.choice([str, str.title])(made()) for _ in range(rng.randint(1, 3))), before + name() + rng.choice(["=", ": ", " = ", '": "'])
                value += rng.choice(["", "", str(rng.randint(1, 2029)), value[:9], "!"]) if len(value) > 5 else value + str(rng.randint(10, 99))
            elif form == 10:
                half = made() + str(rng.randint(1, 99))
                value, before = half + rng.choice(["", half, pick("!#*", 1)]), before + name() + rng.choice(["=", ": ", " = "])
            elif form == 11:
                value = rng.choice([pick(both, rng.randint(6, 20)), made().title() + made() + str(rng.randint(1, 99)), made() + made()])
                before, after = f"{before}{rng.choice(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{word()}:", f"@{word()}.example.com/{word()}" + after
            elif form == 0:
                value = rng.choice(["AKIA", "ASIA"]) + pick(up, 16)
            elif form == 1:
                value, before, after = pick(hexa, rng.choice([32, 40, 64])), before + name() + rng.choice([' = "', '="', ': "']), '"' + after
            elif form == 2:
                value, before = pick(hexa, rng.randint(12, 24)), before + name() + "="
            elif form == 3:
                value = rng.choice(["ghp_", "gho_", "sk_live_", "glpat-", "xoxb-"]) + pick(both, rng.randint(20, 36))
            elif form == 4:
                value, before = pick(both, rng.randint(12, 40)), before + name() + rng.choice(["=", ": ", " = "])
            elif form == 5:
                value = "eyJ" + pick(both, 30) + "." + pick(both, 40)
            elif form == 6:
                value = "AIza" + pick(both + "_-", 35)
            elif form == 7:
                value, before = pick(both[:52], rng.randint(10, 32)), before + name() + rng.choice(["=", ": ", " = ", ' = "'])
            else:
                value, before = pick(both + both + "!@#$%^*", rng.randint(8, 20)), before + name() + rng.choice(["=", ": ", " = ", ': "'])
        else:
            form = rng.randrange(13)
            digits = "0123456789"
            if form == 0:
                value = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            elif form == 1:
                value = f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com"
            elif form == 2:
                value = pick(digits, rng.randint(10, 19))
            elif form == 3:
                value = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
            elif form == 4:
                value, before = pick(hexa, rng.choice([7, 12, 32, 40, 64])), before + rng.choice(["commit ", "sha256:", "md5 ", "checksum ", "rev "])
            elif form == 5:
                value, before = rng.choice(["changeme123", "your_password1", "example-token-1", "xxxxxxxxxx1", "password123"]), before + name() + "="
            elif form == 6:
                value = f"{word()}_{word()}_{rng.randint(1, 2999)}"
            elif form == 7:
                value = f"20{pick(digits, 2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}:00"
            elif form == 8:
                value = f"www.{word()}.example.com/{word()}/{rng.randint(1, 9999)}.html"
            elif form == 9:
                value = f"+{rng.randint(1, 99)}-{pick(digits, 3)}-{pick(digits, 4)}-{pick(digits, 3)}"
            elif form == 10:
                # prose after a name, of words that the text has too
                value, before = "".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))), before + name() + rng.choice([": ", " = ", "="])
                after += f" {value} " + say()
            elif form == 11:
                value, before = rng.choice(["required", "Optional", "None,", "undefined", "********", "<password>", "${SECRET}", "xxxxxxxx", "your-token-here", "changeme"]), before + name() + rng.choice([": ", " = ", "="])
            else:
                value = f"{word()}{rng.randint(1, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 99)}-{word()}"
        rows.append((before, value, after, path, i % 2))
    return rows


#: Words of the corpus that count as common: the most frequent ones, of so many documents at least.
MOST_COMMON, LEAST_DOCS = 20_000, 5


def common_words(docs: DataFrame, text_col: str = "text", most: int = MOST_COMMON, least: int = LEAST_DOCS) -> frozenset[bytes]:
    """The word list: runs of letters by the number of documents that hold them."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit("[a-z]{3,24}"), F.lit(0)))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # written first: a collected top list would come to the driver once a task
    top = written(counts.orderBy(F.desc("n"), "word").limit(most), "words")
    return frozenset(r["word"].encode() for r in top.collect())


def train(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, trees: int = 30, depth: int = 8, seed: int = 9) -> RandomForestClassificationModel:
    """The forest; findings are (before, value, after, path, label 0 or 1).
    Their common words are those of five findings' surroundings or more."""
    rows, findings = [], findings or labelled_findings()
    seen = Counter(w for before, _, after, _, _ in findings for w in prose(f"{before} {after}".encode(), []))
    common = frozenset(w for w, n in seen.items() if n >= LEAST_DOCS)
    for before, value, after, path, label in findings:
        b, v, a = before.encode(), value.encode(), after.encode()
        text, span = b + v + a, (len(b), len(b) + len(v))
        rows.append((*features(text, *span, prose(text, [span]), common, path.encode()), float(label)))
    df = spark.createDataFrame(rows, [*FEATURES, "label"]).coalesce(1)
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(table.select("features", "label"))


_FOUND = pa.schema([("doc_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("value", pa.string()), *((f, pa.float64()) for f in FEATURES)])
_DDL = "doc_id long, begin long, end long, value string, " + ", ".join(f"{f} double" for f in FEATURES)


def _find(common: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for doc_id, text, path in zip(batch.column("doc_id").to_pylist(), bytes_of(batch, "text"), bytes_of(batch, "path")):
                    spans = list(candidates(text or b""))
                    if not spans:
                        continue
                    words = prose(text, spans)
                    for begin, end in spans:
                        yield doc_id, begin, end, text[begin:end].decode("utf-8", "replace"), *features(text, begin, end, words, common.value, path or b"")

        yield from in_slices(rows(), _FOUND)

    return run


def secret_scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, common: frozenset[bytes] | None = None) -> DataFrame:
    """One row per candidate: doc_id, begin, end (bytes), value, score, is_secret.

    ``common``: the word list, at most ``MOST_COMMON`` words; learned from
    ``docs`` unless given.

    Texts without candidates, null and empty ones give no rows; repeated rows
    give their findings again; null ids stay null.  Other columns are not
    read (``path_col`` may name one with the document's path).
    """
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), path.alias("path"))
    common = docs.sparkSession.sparkContext.broadcast(common_words(rows) if common is None else common)
    found = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.mapInArrow(_find(common), _DDL))
    scored = model.transform(found).withColumn("score", vector_to_array("probability")[1])
    return scored.select("doc_id", "begin", "end", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))
