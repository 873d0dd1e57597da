"""Operator 13 against plain loops."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from sluice.llm import fingerprint


def digest(text):
    data = text.encode()
    padded, counts = data + bytes(6), [0] * 512
    for i in range(len(data)):
        word = padded[i] << 16 | padded[i + 3] << 8 | padded[i + 6]
        counts[(word * 2654435761 & 0xFFFFFFFF) >> 16 & 511] += 1
    s = sorted(counts)
    codes = [sum(c > s[k] for k in (127, 255, 383)) for c in counts]
    return math.floor(8 * math.log2(len(data) + 1) + 1e-9), codes


def mark(text):
    length, codes = digest(text)
    return f"{length:03x}" + "".join(f"{4 * a + b:x}" for a, b in zip(codes[::2], codes[1::2]))


def near(a, b):
    (la, ca), (lb, cb) = digest(a), digest(b)
    return 1.0 - (sum(abs(x - y) for x, y in zip(ca, cb)) + 8 * min(24, abs(la - lb))) / (3 * 512 + 192)


def by_hand(rows, order):
    """rows: (doc_id, text) without repeated ones, put in order by ``order``."""
    rows = sorted(rows, key=order)
    out = []
    for (key, text), (_, other) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark(text), mark(edited), near(text, edited), near(text, other)))
    return sorted(out, key=str)


def run(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in extra})
    return sorted(map(tuple, fingerprint.against_edits(docs).collect()), key=str)


def hashes(spark, rows):
    found = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64("text")).collect()
    return {(r[0], r[1]): r[2] for r in found}


def test_against_hand(spark):
    rng = random.Random(4)
    words = "house tree água stone \U0001f600 light paper".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(0, 240, 2)]
    rows += [(301, "z" * 60_000 + "end"), (303, "a"), (305, "ab"), (307, "é")]
    rng.shuffle(rows)
    assert run(spark, rows) == by_hand(rows, lambda r: r[0])


def test_odd_rows(spark):
    rows = [(None, None), (None, ""), (None, "one text"), (None, "another"), (4, "same"), (4, "same"), (4, "other than that"), (5, None), (6, ""), (7, "same")]
    rows = rows * 2
    distinct = sorted({(k, t or "") for k, t in rows}, key=str)
    h = hashes(spark, distinct)
    expected = by_hand(distinct, lambda r: (r[0] is not None, r[0] or 0, h[r]))
    assert run(spark, rows) == expected
    assert run(spark, rows, ("block", "guard", "h", "n", "fingerprint", "near_next")) == expected
    assert run(spark, []) == []
    assert run(spark, [(1, "alone")]) == by_hand([(1, "alone")], lambda r: r[0])
    assert run(spark, [(1, "alone")])[0][6] == 1.0


def test_fingerprints_of_columns(spark):
    rows = [(1, "some text that is long enough"), (2, None), (3, "some text that is long enough")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in ("_source", "source", "fingerprint")})
    got = {r.doc_id: r for r in fingerprint.with_fingerprint(docs).collect()}
    assert got[1].fingerprint == got[3].fingerprint == mark(rows[0][1]) and got[2].fingerprint == mark("")
    assert got[1]["_source"] == got[1]["source"] == "kept" and len(got[1]) == 5
    for t in (rows[0][1], "", "x"):
        back = fingerprint.digest_of(mark(t))
        assert (back.length, back.codes.tolist()) == digest(t)


def test_length_codes_are_those_of_the_logarithm():
    for n in [*range(3000), 10**6, 10**9 + 7, 2**20 - 1, 2**40 - 1]:
        assert fingerprint.length_code(n) == math.floor(8 * math.log2(n + 1) + 1e-9)


def test_an_edited_half_is_nearer_than_another_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = fingerprint.against_edits(docs).where("near_next < 1").selectExpr("avg(int(near_edited > near_next))", "min(near_edited)").head()
    assert found[0] > 0.99 and found[1] > 0.5
