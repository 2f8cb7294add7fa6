"""Mixing, url rules, exact dedup and token counts against brute force, with odd rows."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportloom.llm.common import components
from reportloom.llm.exact_dedup import deduplicated, exact_groups
from reportloom.llm.mixing import mix, mixed_documents
from reportloom.llm.token_counts import over_limit, token_counts
from reportloom.llm.url_filter import Rule, judge, kept_pages

DOCS = "doc_id long, text string, lang string, source string, rank int, row int, digest string"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, 1, 2, "x") for i, t, s in rows], DOCS)


def words(n):
    return " ".join("w" * (1 + k % 3) for k in range(n))


# --- mixing


def shares(sizes, weights=(1, 2, 3), most=3.0):
    """Targets by handing the excess on, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped, left = {}, set(), float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in capped]
        rest = left - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[o] for o in open_) for s in order}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    rows, sizes = [], {}
    for k in range(900):
        source = rng.choice(["a", "b", "é", None, "tiny", "a"]) if k else "tiny"
        source = source if source != "tiny" or k % 50 == 0 else "b"
        n = rng.randint(0, 60)
        rows.append((k, words(n), source))
        sizes[source] = sizes.get(source, 0) + n
    out = mix(docs(spark, rows)).collect()
    wanted = shares(sizes)
    taken = {}
    for r in out:
        assert r.target == pytest.approx(wanted[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.taken * r.rows
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= 31
    again = mix(docs(spark, rows[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in out) == sorted((r.doc_id, r.copies) for r in again)


def test_mix_by_unequal_weights(spark):
    rows = [(k, words(20), "a" if k < 400 else "b") for k in range(800)]
    df = docs(spark, rows)
    out = mix(df, weights=(1.0, 1.0), weight=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).collect()
    even = sum(r.copies for r in out if r.doc_id % 2 == 0)
    odd = sum(r.copies for r in out if r.doc_id % 2)
    assert even + odd == 800 and 2.6 < even / odd < 3.4


@pytest.mark.parametrize("weights", [(1.0, 1.0), (1.0, 7.0)])
def test_mix_by_tilt(spark, weights):
    """Inclusion shares of documents with a high and a low tilt against those that follow from the targets."""
    rows = [(k, words(20), "a" if k < 1600 else "b") for k in range(2400)]
    high = F.col("doc_id") % 4 == 0
    out = mix(docs(spark, rows), weights=weights, tilt=F.when(high, 1.0).otherwise(0.25), seed=5).collect()
    target = shares({"a": 32_000, "b": 16_000}, weights)
    for source, n in (("a", 1600), ("b", 800)):
        base = target[source] / (n * 20)
        mean = (1 + 3 * 0.25) / 4
        reach = 0.8 * min(base, 3 - base)
        assert abs(sum(r.taken for r in out if r.source == source) - target[source]) <= 20
        for tilt, part in ((1.0, n / 4), (0.25, 3 * n / 4)):
            copies = [r.copies for r in out if r.source == source and (r.doc_id % 4 == 0) == (tilt == 1.0)]
            wanted = base + reach * (tilt - mean) / max(mean, 1 - mean)
            assert len(copies) == part and set(copies) <= {int(wanted), int(wanted) + 1}
            assert abs(sum(copies) / part - wanted) < 0.08
    with pytest.raises(ValueError, match="not both"):
        mix(docs(spark, rows), weight=F.lit(1.0), tilt=F.lit(1.0))


def test_mix_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "one two", None), (3, "same text", "b"), (3, "same text", "b"), (4, words(5000), "b")]
    out = {(r.doc_id, r.source): r for r in mix(docs(spark, rows)).collect()}
    assert out[1, "a"].size == 0 and out[1, "a"].taken == 0 and out[3, "b"].rows == 2 and len(out) == 5
    taken = mixed_documents(docs(spark, rows))
    assert taken.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    counts = {(r.doc_id, r.source): r["count"] for r in taken.groupBy("doc_id", "source").count().collect()}
    assert counts == {k: r.copies * r.rows for k, r in out.items() if r.copies}
    assert mix(docs(spark, [])).count() == 0 and mixed_documents(docs(spark, [])).count() == 0


# --- url rules

RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/")]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, component string")


def canonical(url):
    return f"<html><LINK rel='canonical' href=\"{url}\"></html>"


def test_rules_and_components(spark):
    rows = [
        (1, "http://A.Example.com/en/x?q#f", None),
        (2, "https://www.example.com/en/x", ""),
        (3, "https://m.example.com", "x"),
        (4, "no scheme", "x"),
        (5, None, None),
        (6, "http://x.net/es/1", canonical("http://alias.org/one")),
        (7, "http://alias.org/one#top", ""),
        (8, "http://other.org/two", "<meta http-equiv=\"refresh\" content=\"0; url=/three\">"),
        (9, "https://other.org/three", canonical("http://alias.org/one")),
        (10, "http://mixed.org/a", canonical("http://x.net/es/2")),
        (11, "http://mixed.org/b", canonical("http://mixed.org/a")),
        (12, "http://mixed.org/c", canonical("http://www.example.com/en/ok") + canonical("http://unused.org/")),
        (13, "http://mixed.org/d", canonical("http://mixed.org/c")),
        (13, "http://mixed.org/d", canonical("http://mixed.org/a")),
        (14, "http://lonely.org/", canonical("relative.html")),
    ]
    out = judge(pages(spark, rows), RULES)
    told = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert told[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert told[2] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert told[3] == ("m.example.com", "", None, "allow")
    assert told[4] == told[5] == ("", "", None, "allow")
    assert told[6][2:] == ("net/es/", "block")
    assert told[7][2:] == (None, "block") and told[8][2:] == (None, "block") and told[9][2:] == (None, "block")
    # One url of this component is allowed explicitly, so its block is not passed on.
    assert told[10][2:] == told[11][2:] == told[12][2:] == told[13][2:] == (None, "allow")
    assert told[14][2:] == (None, "allow") and out.count() == len(rows)
    kept = kept_pages(pages(spark, rows), RULES)
    assert sorted(r.page_id for r in kept.collect()) == sorted(i for i, *_ in rows if told[i][3] == "allow")
    assert judge(pages(spark, []), RULES).count() == 0


def test_given_redirects(spark):
    edges = spark.createDataFrame([("http://a.org/1", "http://b.net/es/"), (None, "http://c.org/")], "u string, v string")
    out = judge(pages(spark, [(1, "https://a.org/1", ""), (2, "http://c.org/", "")]), RULES, edges)
    assert {r.page_id: (r.verdict, r.passed_on) for r in out.collect()} == {1: ("block", True), 2: ("allow", False)}


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(4)
    chain = list(range(1000, 1120))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, k) for k in range(6, 300)] + [(7, 7), (None, 8), (400, 401), (401, 400)]
    out = components(spark.createDataFrame(edges, "u long, v long"))
    found = {r.node: r.component for r in out.collect()}
    assert found == {k: 1000 for k in chain} | {k: 5 for k in range(5, 300)} | {400: 400, 401: 400}
    assert out.count() == len(found)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- exact dedup


def brute_groups(rows):
    text = {k: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for k, (_, t, _) in enumerate(rows)}
    out = []
    for k, (i, _, _) in enumerate(rows):
        group = [j for j in text if text[j] == text[k]]
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        out.append((i, min(ids) if ids else None, len(group), hashlib.sha256(text[k].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_groups(spark, digest_chars):
    rows = [(k, f"text {k % 7}\n\t number" + "  " * (k % 2), "s") for k in range(40)]
    rows += [(90, None, "s"), (91, "", "s"), (92, " ", "s"), (None, "text 1 number", "s"), (None, "alone", "s"), (None, "alone", "s")]
    rows += [(3, "text 3 number", "s"), (3, "text 3 number", "s"), (95, "é" * 50_000, "s"), (96, "é" * 50_000, "s"), (97, "a b", "s"), (98, "a b", "s")]
    df = docs(spark, rows).repartition(6)
    out = exact_groups(df, digest_chars=digest_chars, files_per_batch=2)
    found = out.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.sha256) for r in found), key=repr) == brute_groups(rows)
    kept = [r for r in found if r.kept]
    assert len(kept) == len({r.sha256 for r in found}) and all(r.doc_id == r.keep_id for r in kept)
    left = deduplicated(df, digest_chars=digest_chars)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((r.doc_id for r in kept), key=repr)


def test_exact_groups_of_nothing(spark):
    assert exact_groups(docs(spark, [])).count() == 0 and deduplicated(docs(spark, [])).count() == 0


# --- token counts


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcé '!1") for _ in range(rng.randint(1, 9))) for _ in range(200))
    texts = [
        text, "x" * 900, "a" * 300 + " " + "b" * 500 + "\n" * 300 + "end", None, "", " " * 700, "<|endoftext|> a" * 60,
        "é  " * 200, "don't\x1c!" * 100, "a  b c \n" * 40, " one\n two\n\nthree ", "trailing ", text,
    ]
    rows = [(None if k == 2 else k % 9, t, "s") for k, t in enumerate(texts)]
    out = token_counts(docs(spark, rows), path, chunk_chars=64, overlap_chars=16)
    found = sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out.collect()), key=repr)
    wanted = [(i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows]
    assert found == sorted(wanted, key=repr)
    assert token_counts(docs(spark, []), path).count() == 0
    assert [r[0] for r in spark.range(1024, 1026).select(over_limit(F.col("id"))).collect()] == [False, True]
