"""Periodic runs and fill-in-the-middle: against brute force and exact round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import words_of
from pyspark.sql import functions as F

from siftgraph.llm import fill_middle, periodic_runs, queries


def brute_runs(words):
    """All runs by comparing every pair of words, smallest period first."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_altered(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def by_start(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(rng.randint(0, 260))]
    if kind == 1:
        unit = [rng.choice("abcdef") for _ in range(rng.randint(1, 60))]
        head, tail = ([rng.choice("abx") for _ in range(rng.randint(0, 20))] for _ in range(2))
        return head + unit * rng.randint(1, 6) + unit[: rng.randint(0, len(unit))] + tail
    if kind == 2:
        a, b = ["a"], ["b"]
        for _ in range(rng.randint(1, 11)):
            a, b = a + b, a
        return a
    if kind == 3:
        return [w for _ in range(rng.randint(1, 9)) for w in ["x"] * rng.randint(1, 20) + [rng.choice("yz")]]
    unit = ["u", "v", "u", "v", "w"] * rng.randint(1, 7)
    return (unit + [str(rng.random())]) * rng.randint(1, 5)


def test_runs_equal_brute_force():
    rng = random.Random(11)
    for _ in range(400):
        words = repetitive(rng)
        got = periodic_runs.word_runs([w.encode() for w in words])
        assert got == by_start(brute_runs(words)), words


def test_runs_of_long_periods_and_peeled_segments():
    rng = random.Random(12)
    unit = [f"w{rng.randrange(10**9)}" for _ in range(3001)]
    words = [b"x", *[u.encode() for u in unit * 3], b"y"]
    assert periodic_runs.word_runs(words) == [(1, 9003, 3001)]
    # each round takes one more word from the end: splitting is given up, the scan still decides
    chain = [f"c{(i + 1) // 2 if i % 2 else i // 2 - 1}" for i in range(600)] + ["r", "s"] * 8 + ["r"]
    assert periodic_runs.word_runs([w.encode() for w in chain]) == brute_runs(chain)
    assert periodic_runs.word_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    assert periodic_runs.word_runs([b"a"] * 11) == []


def test_find_runs_awkward(docs, awkward, nothing):
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find_runs(docs).collect()), key=str
    )
    want = []
    for i, text, *_ in awkward:
        words = words_of(text)
        runs = by_start(brute_runs(words)) if len(words) < 500 else []
        want.append((i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic_runs.find_runs(nothing).collect() == []


def test_periodic_runs_query_equals_brute_force(spark, small):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    planted = 0
    for d in docs:
        words = brute_altered(d.doc_id, words_of(d.text))
        if len(words) > 1500:
            continue
        planted += zlib.crc32(str(d.doc_id).encode()) % 10 == 0
        runs, r = by_start(brute_runs(words)), rows[d.doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        exponent = 1000 * best[1] // best[2] if best else None
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, exponent) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert planted > 5


def test_planted_periods_leave_texts_without_words(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(ids[0], None), (ids[1], " \t"), (ids[2], "one"), (ids[3], " a  b\tc d e f g h i j "), (None, "a b c")]
    got = {r.doc_id: r.text for r in periodic_runs.with_planted_periods(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[ids[0]] is None and got[ids[1]] == " \t" and got[ids[2]] == "one" and got[None] == "a b c"
    assert got[ids[3]] == " ".join(brute_altered(ids[3], "a b c d e f g h i j".split()))


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng, count):
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "a", "é", "\x85", "\xa0", "中", "\U0001f600", "\x89\x8d", "<P"]
    texts = ["", " ", "a", " a", "a ", "x" * 64, " " * 64, "<M> in it", "ends <S>", None]
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70))) for _ in range(count)]


def test_fill_middle_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(odd_texts(rng, 800))] + [(None, "no id here"), (3, "same id twice")]
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    got = sorted((tuple(r) for r in made.withColumn("back", back).collect()), key=str)
    assert got == sorted(((i, *brute_fim(i, t), t or "") for i, t in rows), key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}


def test_fill_middle_awkward_and_shares(spark, docs, awkward, nothing):
    got = sorted((tuple(r) for r in fill_middle.transform(docs).collect()), key=str)
    assert got == sorted(((i, *brute_fim(i, t)) for i, t, *_ in awkward), key=str)
    assert fill_middle.transform(nothing).collect() == []
    forms = {f: spark.range(40).selectExpr("id AS doc_id", "'a b c' AS text") for f in ("plain", "spm", "psm")}
    for form, percents in {"plain": (0, 50), "spm": (100, 100), "psm": (100, 0)}.items():
        assert {r.form for r in fill_middle.transform(forms[form], 1, *percents).collect()} == {form}
    with pytest.raises(ValueError):
        fill_middle.transform(docs, 1, 101)


def test_space_marks_of_all_bytes():
    lanes = np.arange(256, dtype=np.uint8)
    marks = fill_middle.space_marks(lanes.view("<u8")).view(np.uint8)
    assert np.flatnonzero(marks).tolist() == [9, 10, 11, 12, 13, 32]
    assert set(marks[marks > 0].tolist()) == {0x80}
