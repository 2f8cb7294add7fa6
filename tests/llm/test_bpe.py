"""Byte-level BPE against the tokenizers library, piece by piece and in Spark."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reportloom.llm import bpe
from reportloom.llm.bpe import BytePairs, PairTable, TokenBytes, decode, encode, merged, merged_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def model():
    return BytePairs(PATH)


@pytest.fixture(scope="module")
def bytes_of():
    return TokenBytes(PATH)


def same(model, library, texts):
    decoded = TokenBytes(PATH).decode
    flat, ends = model.encode(texts)
    got = [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    wanted = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for text, a, b in zip(texts, got, wanted, strict=True):
        assert a == b, text[:200]
        assert decoded(a) == library.decode(b, skip_special_tokens=False), text[:200]


def test_merges_one_by_one():
    """Against the definition: look for the leftmost pair of the lowest rank, merge it, begin again."""
    rng = random.Random(3)
    for _ in range(400):
        symbols = rng.randint(2, 4)
        ranks, results, top = {}, [], symbols
        for _ in range(rng.randint(1, 12)):
            pair = (rng.randrange(top), rng.randrange(top))
            if pair not in ranks:
                ranks[pair] = len(results)
                results.append(top)
                top += 1
        ids = [rng.randrange(symbols) for _ in range(rng.randint(0, 40))]
        plain = list(ids)
        while found := [(ranks[p], k) for k, p in enumerate(zip(plain, plain[1:], strict=False)) if p in ranks]:
            rank, k = min(found)
            plain[k : k + 2] = [results[rank]]
        assert merged(ids, ranks, results) == plain
        size = 1 << max(0, len(ids) - 2).bit_length()
        rows = np.full((2, size + 1), -1)
        rows[1, : len(ids)] = ids
        together = merged_rows(rows, PairTable(ranks, results))
        assert together[1][together[1] >= 0].tolist() == plain and (together[0] == -1).all()


def test_every_character(model, library):
    """Each code point beside letters, digits, signs and white space; unassigned ones aside, whose class libraries disagree on."""
    import unicodedata

    points = [chr(k) for k in range(0x3400) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    points += [chr(k) for k in range(0x3400, 0x30000, 97) if not 0xD800 <= k < 0xE000 and unicodedata.category(chr(k)) != "Cn"]
    same(model, library, [f"a{c}b {c} {c}{c}1 !{c}? \n{c}\t{c}x's{c}" for c in points])


def test_random_texts(model, library):
    rng = random.Random(5)
    parts = ["the", " the", "  ", "\n", "\n\n", "\t", " ", "'ll", "'S", "Straße", "日本", "é", "e\u0301", "\U0001f469\u200d\U0001f469\u200d\U0001f467", "123", "!!", "<|endoftext|>", "<|end", "\x00", "\x1c", "\u200b", "x" * 30, "ab" * 40]
    same(model, library, ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)])


def test_long_runs(model, library):
    rng = random.Random(6)
    same(model, library, ["a" * 100_000, "".join(rng.choices("abc", k=50_000)), " " * 70_000, "word " * 60_000, "=" * 65_537])
    # n log n: eight times the symbols take far less than 64 times as long.
    times = []
    for n in (20_000, 160_000):
        begin = time.perf_counter()
        merged([int(model.of_byte[b]) for b in rng.choices(b"etaoin", k=n)], model.table.ranks, model.table.results)
        times.append(time.perf_counter() - begin)
    assert times[1] < 30 * times[0]


def test_ids_that_are_no_text(bytes_of, library):
    for ids in ([255], [130, 131, 132], [], [50256, 50256], list(range(100, 300)), [60_000], [5, -1, 7]):
        wanted = library.decode([i for i in ids if i >= 0], skip_special_tokens=False)
        assert bytes_of.decode(ids) == wanted


def test_encode_and_decode_rows(spark, library):
    rows = [(1, "Hello  world<|endoftext|>", 7), (1, "Hello  world<|endoftext|>", 7), (None, None, 8), (3, "", 9), (4, "wörter " * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    ids = encode(df, PATH)
    assert ids.columns == ["doc_id", "n_tokens", "ids"]
    got = decode(ids.withColumn("kept", F.col("ids")), PATH).collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    assert sorted(((r.doc_id, r.text, r.n_tokens) for r in got), key=key) == sorted(((i, t or "", n) for i, t, n in rows), key=key)
    for r in got:
        assert list(r.kept) == library.encode(r.text, add_special_tokens=False).ids
    assert encode(df.limit(0), PATH).collect() == [] and decode(ids.limit(0), PATH).collect() == []
    odd = spark.createDataFrame([(1, None), (2, [None, 262, 10**6])], "a int, ids array<int>")
    assert [r.text for r in decode(odd, PATH).orderBy("a").collect()] == ["", library.decode([262], skip_special_tokens=False)]
    with pytest.raises(ValueError, match="N_tokens"):
        encode(df, PATH, ids_col="N_tokens")


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        BytePairs(public_tokenizers.path("word_bpe_49k.json"))


def test_query_on_given_documents(spark, library):
    import hashlib

    from reportloom.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op11_pair_tree_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_plain_ids_are_decoded_by_the_array(library, monkeypatch):
    """Rows of ids in the vocabulary are no Python objects, cut characters and empty rows among them."""
    rng = np.random.default_rng(5)
    whole = library.encode("Größe 12, 日本語 🙂 <|end|>", add_special_tokens=False).ids
    rows = [rng.integers(0, 50_000, n).tolist() for n in (0, 1, 900, 40)] + [None, [], whole, whole[:-3], whole[5:], list(range(256)) * 2000]
    wanted = [library.decode(row or [], skip_special_tokens=False) for row in rows]

    def fails(*_):
        raise AssertionError("one by one")

    monkeypatch.setattr(TokenBytes, "decode", fails)
    batch = pa.record_batch([pa.array(range(len(rows) + 1)), pa.array([[7], *rows], pa.list_(pa.int32()))], names=["a", "ids"])
    found = pa.Table.from_batches(list(bpe._decode(iter([batch.slice(1), batch.slice(0, 0)]), PATH, "ids", "text")))
    assert found.column("text").to_pylist() == wanted and found.column("a").to_pylist() == list(range(1, len(rows) + 1))
