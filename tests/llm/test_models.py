"""Toxicity, personal data, byte model: forward sums, tiny models and held-out documents against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reportloom.llm import pii, ppm, toxicity as tox
from reportloom.llm.pii import KINDS, canonical, meets_base, personal_data, written
from reportloom.llm.ppm import CLASSES, byte_classes, escape_levels, score_texts
from reportloom.plans.staging import collecting

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score string, spans string, base string, chunk int, key int"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", "s", "b", 1, 2) for i, t in rows], DOCS)


# --- toxicity


def test_marginals_equal_sums_over_all_paths():
    rng = np.random.default_rng(0)
    model = tox.Field(steps=rng.normal(size=(2, 2)), start=rng.normal(size=2))
    lengths = [1, 5, 9, 2]
    gain = rng.normal(size=sum(lengths)) * 2
    first = np.zeros(len(gain), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    found, pairs = tox.forward_backward(gain, first, model)
    wanted, steps = [], np.zeros((2, 2))
    at = 0
    for n in lengths:
        own, total, each = gain[at : at + n], 0.0, np.zeros(n)
        counted = np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=n):
            weight = model.start[path[0]] + sum(model.steps[a, b] for a, b in zip(path, path[1:]))
            weight = math.exp(weight + sum(g for g, s in zip(own, path) if s))
            total += weight
            each += weight * np.array(path)
            for a, b in zip(path, path[1:]):
                counted[a, b] += weight
        wanted.extend(each / total)
        steps += counted / total
        at += n
    assert np.allclose(found, wanted) and np.allclose(pairs, steps)


def test_long_documents_cross_blocks():
    rng = np.random.default_rng(1)
    gain, first = rng.normal(size=3 * tox.STEPS + 17), np.zeros(3 * tox.STEPS + 17, bool)
    first[[0, tox.STEPS - 1, 2 * tox.STEPS + 5]] = True
    found, _ = tox.forward_backward(gain, first, tox.Field())
    for begin, end in ((0, tox.STEPS - 1), (tox.STEPS - 1, 2 * tox.STEPS + 5), (2 * tox.STEPS + 5, len(gain))):
        alone, _ = tox.forward_backward(gain[begin:end], first[begin:end], tox.Field())
        assert np.allclose(found[begin:end], alone)


def test_held_out_toxicity(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in tox.toxicity(documents, labels).collect()}
    known = {r.doc_id: r.toxic for r in labels.collect()}
    held = [k for k in known if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(out[k].held_out for k in held) and sum(r.held_out for r in out.values()) < len(out) / 2
    right = sum((out[k].score >= 0.7) == bool(known[k]) for k in held)
    toxic = [k for k in held if known[k]]
    assert right >= 0.93 * len(held) and sum(out[k].score >= 0.7 for k in toxic) >= 0.6 * len(toxic)
    # The labels of held-out documents teach nothing.
    other = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    again = {r.doc_id: r.score for r in tox.toxicity(documents, other).collect()}
    assert all(abs(again[k] - out[k].score) < 1e-9 for k in out)


def test_toxic_spans_and_odd_rows(spark):
    rng = random.Random(3)
    plain = ["river", "stone", "cloud", "letter", "window", "garden", "paper", "music"]
    rows, labels = [], []
    for k in range(300):
        text = [rng.choice(plain) + str(rng.randint(0, 40)) for _ in range(30)]
        if k % 3 == 0:
            text[rng.randint(0, 29)] = rng.choice(["vile", "Rotten!"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 3 == 0)))
    rows += [(1000, None), (1001, ""), (None, "a rotten thing"), (1002, "so vile. " * 3), (1002, "so vile. " * 3), (1003, "river7 " * 30_000)]
    labels += [(None, 1), (0, 0), (5000, 1), (7, None)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = tox.toxicity(docs(spark, rows), marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    found = {}
    for r in out:
        found.setdefault(r.doc_id, []).append(r)
    assert [(s.start, s.end) for s in found[None][0].spans] == [(2, 8)] and found[None][0].score > 0.7
    assert [r.score for r in found[1002]] == [found[1002][0].score] * 2 and found[1002][0].score > 0.7
    assert found[1000][0].score == found[1001][0].score < 0.5 and found[1003][0].score < 0.5
    assert tox.toxicity(docs(spark, []), marks).count() == 0
    assert {r.score for r in tox.toxicity(docs(spark, rows), marks.where("toxic = 0")).collect()} == {0.0}


# --- personal data


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans(spark):
    rng = random.Random(5)
    texts = [
        None, "", "a@b.c._d@e.f x@y.com-z@w.org", "é 1.2.3.4.5.6.7 😀 300.1.1.1 0001.02.003.255", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (980) 555-6268, +12 +1-2-3 +44 20 7946 0958.", "5" * 20_000, "1 " * 9_000, "user@host @x.y a@b", "+" + "1. " * 3_000 + "x",
    ]
    texts += ["".join(rng.choice("0123456789 -.+@ab()") for _ in range(120)) for _ in range(300)]
    rows = [(None if k == 1 else k, t) for k, t in enumerate(texts)] + [(5, texts[5])]
    out = personal_data(docs(spark, rows))
    out = out.select("doc_id", written(out["base"]).alias("told"), "added").collect()
    wanted = sorted(((i, ",".join(brute_spans(t))) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.told) for r in out), key=repr) == wanted
    assert personal_data(docs(spark, [])).count() == 0


def test_boosted_candidates_add_spans(spark):
    """Addresses with a written-out sign look like those that the base finds, in form and context; bare numbers do not."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        form = f"{name}@host{k}.org" if k % 2 else f"{name} (at) host{k}.org"
        rows.append((k, f"write a mail to {form} or see part {rng.randint(10**15, 10**16 - 1)} of it"))
    out = personal_data(docs(spark, rows)).collect()
    texts = dict(rows)
    assert all(len([b for b in r.base if b.kind == 0]) == r.doc_id % 2 for r in out)
    for r in out:
        for a in r.added:
            assert KINDS[a.kind] in ("email", "ip", "card", "phone") and 0 <= a.start < a.end <= len(texts[r.doc_id])
            assert not any(a.start < b.end and b.start < a.end for b in r.base)


def test_spelled_out_addresses_are_added_and_bare_numbers_are_not(spark):
    rng = random.Random(8)
    rows = []
    for k in range(600):
        name = "".join(rng.choice("abcdefgh") for _ in range(6))
        form = f"{name}@host{k}.org" if k % 2 else f"{name} (at) host{k}.org"
        bare = rng.randint(10**15, 10**16 - 1)
        bare += luhn(str(bare))  # a changed last digit fails the check
        rows.append((k, f"write a mail to {form} or see part {bare} of it, {rng.randint(10**9, 10**10 - 1)} in all"))
    texts, out = dict(rows), personal_data(docs(spark, rows)).collect()
    for r in out:
        told = [(KINDS[a.kind], texts[r.doc_id][a.start : a.end]) for a in r.added]
        written_out = re.search(r"[a-h]+ \(at\) \S+", texts[r.doc_id])
        assert told == ([("email", written_out.group())] if written_out else [])


def test_canonical_forms(spark):
    cases = [
        ("email", "ann (at) host.org", True), ("email", "ann at host dot org", True), ("email", "look at host.org", False),
        ("email", "ann[at]host [dot] org", True), ("ip", "2001:db8:0:0:0:0:0:1", True), ("ip", "10:20:30:40", False), ("ip", "10.0.0.300", False),
        ("card", "4111.1111.1111.1111", True), ("card", "4111.1111.1111.1112", False), ("phone", "(743) 555-3824", True),
        ("phone", "(1743) 555-38242", True), ("phone", "0044 20 7946 0958", True), ("phone", "2123465659", False),
        ("phone", "2024-01-15 1022", False),
    ]
    rows = spark.createDataFrame([(KINDS.index(k), m, w) for k, m, w in cases], "kind int, match string, wanted boolean")
    told = rows.select("match", "wanted", meets_base(rows["kind"], canonical(rows["kind"], rows["match"])).alias("told"))
    assert [(r["match"], r["told"]) for r in told.collect()] == [(m, w) for _, m, w in cases]


def test_every_candidate_is_learnt_from_and_judged_by_the_other_half(spark):
    """More candidates of a kind than any sample held: the odd half's labels are the even half's turned round."""
    rows = spark.range(12_000, numPartitions=4).selectExpr(
        "id AS doc_key", "0 AS kind", "0 AS start", "1 AS end", "id % 4 < 2 AS touched", "CAST(id % 2 AS INT) AS half",
        "CAST((id DIV 4 + id) % 2 AS DOUBLE) AS label", "CAST(id DIV 4 % 2 AS DOUBLE) AS x",
    )
    judged = pii.cross_judged(rows.withColumn("features", array_to_vector(F.array("x"))).drop("x"))
    found = judged.groupBy(F.col("label") == (F.col("chance") > 0.5).cast("double")).count().collect()
    assert [tuple(r) for r in found] == [(False, 12_000)]
    told = judged.withColumn("chance", F.when(F.col("doc_key") % 15 == 0, 0.8).otherwise(0.9)).withColumn("label", (F.col("doc_key") % 15 != 0).cast("double"))
    assert pii.thresholds(told) == {0: 0.9}


# --- byte model


def slow_probability(counts, context, symbol):
    """One symbol's probability, escape by escape."""
    excluded, left = set(), 1.0
    for k in range(len(context), -1, -1):
        own = {s: n for s, n in counts[context[len(context) - k :]].items() if s not in excluded}
        if own:
            total = sum(own.values())
            more = len(own) + len(excluded) < CLASSES
            if symbol in own:
                return left * ((own[symbol] - 0.5) if more else own[symbol]) / total
            left *= 0.5 * len(own) / total
            excluded |= own.keys()
    return left / (CLASSES - len(excluded))


def test_scores_equal_a_slow_model(spark):
    texts = {k: t for k, t in enumerate(["the cat sat", "The hat, the mat.", "été à la mer", "", "cat cat 42!", "x" * 40, "a\nb\tc"] * 3)}
    rows = list(texts.items()) + [(100, None), (101, "the cat sat on 9 mats; élan")]
    out = {r.doc_id: r for r in score_texts(docs(spark, rows)).collect()}
    counts, inner, words = {}, Counter(), Counter()
    kinds = byte_classes()

    def walk(text):
        past, before = (0,) * ppm.ORDER, 0
        for byte in (text or "").encode():
            yield past, before, int(kinds[byte]), byte
            past, before = (*past[1:], int(kinds[byte])), int(kinds[byte])

    class Counts(dict):
        def __missing__(self, key):
            return {}

    counts = Counts()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 == 1:
            continue
        words.update([*(text or "").encode().lower().split(), None])
        for past, before, kind, byte in walk(text):
            inner[before, byte] += 1
            for k in range(ppm.ORDER + 1):
                row = counts.setdefault(past[ppm.ORDER - k :], {})
                row[kind] = row.get(kind, 0) + 1
    total = sum(words.values())
    for i, text in rows:
        wanted = 0.0
        for past, before, kind, byte in walk(text):
            own = [inner[before, b] + 0.5 for b in range(256) if kinds[b] == kind]
            wanted += math.log10(slow_probability(counts, past, kind)) + math.log10((inner[before, byte] + 0.5) / sum(own))
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((words[w] + 0.5) / (total + 0.5 * (len(words) + 1))) for w in tokens)
        r = out[i]
        assert r.score == pytest.approx(wanted, abs=1e-5 + 7e-5 * len((text or "").encode())) and r.base_score == pytest.approx(base)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(words[w] > 0 for w in tokens), total)


def test_whole_bytes_equal_a_slow_model(spark):
    """Real bytes as contexts: digits, cases and lead bytes are told apart, and the code lengths are not rounded."""
    texts = ["the cat sat 11 12 13", "The hat, the mat.", "été à la мера", "", "cat cat 42!", "x" * 40, "日本語の日本 語"] * 3
    rows = [*enumerate(texts), (100, None), (101, "the cat sat on 19 mats; élan 日の"), (102, "the cat sat on 19 mats; élan 日の")]
    counts = {}

    def walk(text):
        data = b" " * ppm.ORDER + (text or "").encode()
        return [(data[k - ppm.ORDER : k], data[k]) for k in range(ppm.ORDER, len(data))]

    def chance(past, byte):
        excluded, left = set(), 1.0
        for k in range(ppm.ORDER + 1):
            own = {s: n for s, n in counts.get(past[k:], {}).items() if s not in excluded}
            if own:
                if byte in own:
                    return left * (own[byte] - 0.5) / sum(own.values())
                left *= 0.5 * len(own) / sum(own.values())
                excluded |= own.keys()
        return left / (256 - len(excluded))

    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for past, byte in walk(text):
                for k in range(ppm.ORDER + 1):
                    row = counts.setdefault(past[k:], Counter())
                    row[byte] += 1
    out = {r.doc_id: r.score for r in score_texts(docs(spark, rows), whole_bytes=True).collect()}
    for i, text in rows:
        assert out[i] == pytest.approx(sum(math.log10(chance(*step)) for step in walk(text)), abs=1e-9)
    assert sum(chance(b"cat ", byte) for byte in range(256)) == pytest.approx(1)
    lone = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    assert score_texts(docs(spark, [(lone, "ab")]), whole_bytes=True).first().score == pytest.approx(2 * math.log10(1 / 256))
    assert score_texts(docs(spark, []), whole_bytes=True).count() == 0


def test_chunks_leave_in_small_batches():
    rng = np.random.default_rng(2)
    grams = np.unique(rng.integers(0, 1 << 40, 100_000))
    keys = [np.unique(rng.integers(1, 1 << 60, 50_000)).astype(np.uint64) for _ in range(2)]
    nulls = [pa.nulls(2, kind) for kind in (pa.float64(), pa.binary())]
    found = list(ppm._chunk_rows(7, keys, [True, False], pa.array([1, 2]), nulls[0], (grams, grams * 0), nulls[1]))
    assert max(batch.num_rows for batch in found) <= ppm.ROWS
    rows = pa.Table.from_batches(found)
    assert rows.column("cell").drop_null().to_pylist() == grams.tolist() and set(rows.column("chunk").to_pylist()) == {7}
    dictionary = np.array(rows.column("key").drop_null().to_pylist()).view(np.uint64)
    held = rows.filter(pc.is_valid(rows.column("doc_id"))).column("places").to_pylist()
    assert all(np.array_equal(np.sort(dictionary[places]), own) for places, own in zip(held, keys, strict=True))


def test_texts_travel_compressed_and_chunks_learn_from_each_other(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{k:x}" for k in rng.integers(0, 1 << 30, 900)]
    rows = [(k, " ".join(rng.choice(vocabulary, 300)) + f" only{k}") for k in range(60)]
    paths = []
    with collecting(paths):
        whole = score_texts(docs(spark, rows).coalesce(1), whole_bytes=True).collect()
    chunks = spark.read.parquet(next(path for path in paths if "ppm-chunks" in path))
    sent = chunks.agg(F.sum(F.length("text")).alias("n"), F.count("places").alias("lists")).first()
    assert sent.n < sum(len(text) for _, text in rows) / 2 and not sent.lists
    # Many chunks: words and contexts that only other chunks have, and words that only one has.
    parts = score_texts(docs(spark, rows).repartition(7), whole_bytes=True).collect()
    known = {r.doc_id: r for r in whole}
    for r in parts:
        one = known[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (one.held_out, one.n_tokens, one.n_known, one.train_tokens)
        assert r.score == pytest.approx(one.score) and r.base_score == pytest.approx(one.base_score)
        assert r.n_tokens - r.n_known == r.held_out
    assert len(parts) == len(rows)


def test_model_odd_rows(spark):
    rows = [(None, "word " * 9), (1, None), (2, "tail " * 200_000), (2, "tail " * 200_000), (3, "퟿ ok"), (7, " ")]
    out = score_texts(docs(spark, rows)).collect()
    assert len(out) == 6 and all(r.score <= 0 and r.n_tokens >= 1 for r in out)
    assert {r.score for r in out if r.doc_id == 1} == {0.0}
    assert len({r.score for r in out if r.doc_id == 2}) == 1
    assert score_texts(docs(spark, [])).count() == 0
    # Nothing to learn from: everything is as likely as its class allows.
    lone = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    only = score_texts(docs(spark, [(lone, "ab")])).first()
    assert only.held_out and only.n_known == only.train_tokens == 0
    assert only.score == pytest.approx(2 * math.log10(1 / CLASSES / 2), abs=1e-4)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    leaves = rng.integers(0, 4, (1024, CLASSES)) * (rng.random((1024, CLASSES)) < 0.1)
    leaves[5] = 0
    low = rng.integers(0, 4, (1, CLASSES))
    counts = [leaves.sum(0, keepdims=True) + low, leaves.sum(0, keepdims=True)]
    counts += [leaves.reshape(-1, CLASSES**k, CLASSES).sum(0) for k in range(3)]
    assert np.allclose(escape_levels(counts).sum(1), 1) and escape_levels(counts).min() > 0
