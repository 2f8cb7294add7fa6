"""Spelling variants against all pairs of words, and word counts against a plain count."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reportloom.llm.spelling import spelling_variants, without_letter, word_counts


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts):
    near = {w: [o for o in counts if one_edit(w, o)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return out


def found(spark, rows, partitions=3):
    df = spark.createDataFrame([(w, n, 1, "x", "y") for w, n in rows], "word string, n long, near int, root string, key string")
    return [tuple(r) for r in spelling_variants(df.repartition(partitions)).collect()]


@pytest.mark.parametrize("letters", ["ab", "abcé", "aβ𝛽z"])
def test_against_all_pairs(spark, letters):
    rng = random.Random(letters)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))): rng.choice([1, 2, 3, 9, 40, 200]) for _ in range(250)}
    out = found(spark, list(counts.items()))
    assert len(out) == len(counts) and set(out) == expected(counts)


def test_odd_words(spark):
    long = "x" * 300
    rows = [("", 5), ("a", 9), ("aa", 30), ("aaa", 30), (long, 4), (long + "x", 8), (long[:150] + "y" + long[151:], 2), (None, 3), ("b", None)]
    counts = {w: n for w, n in rows if w is not None and n is not None}
    assert set(found(spark, rows)) == expected(counts)
    # Repeated words are one word with the sum of their counts.
    assert set(found(spark, [("cat", 1), ("cat", 2), ("cut", 6)])) == expected({"cat": 3, "cut": 6})
    assert found(spark, []) == []


def test_long_chain_of_forms(spark):
    counts = {"z" * k: 2**k for k in range(1, 41)}
    out = {r[0]: r[2] for r in found(spark, list(counts.items()))}
    assert set(out.values()) == {"z" * 40}


def test_many_variants_of_one_word(spark):
    """A word with all its variants by one letter: rows stay within the alphabet for each place."""
    counts = {"banana": 10_000}
    for i in range(6):
        for c in "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõö":
            counts.setdefault("banana"[:i] + c + "banana"[i + 1 :], 1 + ord(c) % 7)
    assert set(found(spark, list(counts.items()))) == expected(counts)


def test_word_counts(spark):
    rng = random.Random(4)
    words = ["Über", "straße", "hello", "Hello", "ÀÉ", "worlds", "x1y", "don't"]
    rows = [(k if k % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for k in range(200)]
    rows += [(7, None), (7, ""), (8, "hello," * 30_000), (8, "hello," * 30_000)]

    def change(doc_id, run):
        h = F.crc32(F.concat(doc_id, F.lit(":"), run).cast("binary"))
        return F.when(h % 7 == 0, without_letter(run, h % F.char_length(run))).otherwise(run)

    wanted = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            wanted[run if h % 7 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    wanted = {w: n for w, n in wanted.items() if len(w) >= 4 and n >= 3}
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    got = word_counts(df, change, least_length=4).collect()
    assert {r.word: r.n for r in got} == wanted and len(got) == len(wanted)
    assert word_counts(df.limit(0)).collect() == []
