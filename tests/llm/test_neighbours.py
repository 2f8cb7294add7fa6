"""Packing, near duplicates and the pipeline against brute force, with odd rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reportloom.llm import common, ngram_join, toxicity as tox
from reportloom.llm.toxicity import toxicity
from reportloom.llm.catalog import ORACLES, QUERIES
from reportloom.llm.embed_dedup import near_duplicate_vectors, recall
from reportloom.llm.ngram_join import near_duplicates, prefix_length, without_near_duplicates
from reportloom.llm.packing import hilbert, pack, sequences, tail_lengths

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n long, d long, token long, component long, row long, key long"


def docs(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6) for i, t in rows], DOCS)


def united(nodes, links):
    parent = {k: k for k in nodes}

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in nodes}


# --- packing


@pytest.mark.parametrize(("axes", "bits"), [(2, 4), (3, 3)])
def test_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    place = hilbert(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_tail_needs_no_padding():
    for rest in (0, 1, 6, 1234, 4095):
        assert sum(tail_lengths(rest)) == rest and all(n & (n - 1) == 0 for n in tail_lengths(rest))


def test_packed_pieces(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["it's", "Été", "x9", "<|endoftext|>", "b c", "no!"]) for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", "word " * 3_000, texts[0], texts[0], "\x01 a"]
    rows = [(None if k == 5 else k % 50, t) for k, t in enumerate(texts)]
    out = pack(docs(spark, rows).repartition(4), path, length=64)
    pieces = out.collect()
    wanted = sorted(([i, *model.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows), key=repr)
    # Pieces of a row follow one another in the run of tokens; rows that share an id are told apart by that.
    run = sorted(pieces, key=lambda p: (p.sequence_id, p.offset))
    found, current = [], None
    for p in run:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
        if p.start == 0:
            current = [p.doc_id]
            found.append(current)
        assert current[0] == p.doc_id and len(current) - 1 == p.start
        current.extend(ids)
        assert len(current) - 1 <= p.doc_tokens
    assert sorted(found, key=repr) == wanted
    lengths = {}
    for p in run:
        assert p.offset == lengths.get(p.sequence_id, 0)
        lengths[p.sequence_id] = p.offset + p.length
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())
    assert sum(n == 64 for n in lengths.values()) == sum(lengths.values()) // 64
    whole = {r.sequence_id: r for r in sequences(out).collect()}
    assert {k: len(r.ids) // 4 for k, r in whole.items()} == lengths
    assert b"".join(bytes(whole[k].ids) for k in sorted(whole)) == b"".join(bytes(p.ids) for p in run)
    assert pack(docs(spark, []), path).count() == 0


def test_copies_lie_together(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(k, f"topic {k % 10} " + f"word{k % 10} " * 40) for k in range(100)]
    run = sorted(pack(docs(spark, rows), path).collect(), key=lambda p: (p.sequence_id, p.offset))
    topics = [p.doc_id % 10 for p in run if p.start == 0]
    assert sum(a != b for a, b in zip(topics, topics[1:])) == 9


# --- n-gram join


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [
        (a, b)
        for k, (a, x) in enumerate(sets)
        for b, y in sets[:k]
        if x & y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    return united({i for i, _ in sets}, links), len(links)


def edited(rng, words, times):
    out = list(words)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("seed", range(2))
def test_components_of_near_copies(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for k in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 40, 120, 300]))]
        for c in range(rng.choice([1, 1, 2, 4])):
            rows.append(edited(rng, base, c * max(1, len(base) // 60)))
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows += [edited(rng, base, rng.randint(0, 6)) for _ in range(50)]  # many near copies, some linked only through others
    rows += [passage + [rng.choice(vocabulary) for _ in range(rng.randint(2, 60))] for _ in range(40)]  # a shared passage
    rows += [edited(rng, passage, 1) for _ in range(10)]
    rng.shuffle(rows)
    listed = [(k * 3 + 1, " ".join(w)) for k, w in enumerate(rows)]
    listed += [(5000, None), (5001, ""), (5002, " \n"), (5003, "Two Words"), (5004, "two  words"), (None, "two words"), (listed[0][0], listed[0][1])]
    listed += [(5005, "b a " * 20_000), (5006, "B A " * 20_000)]
    wanted, links = brute_components(listed)
    assert links > 100
    out = near_duplicates(docs(spark, listed))
    found = out.collect()
    assert len(found) == len(listed)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == wanted
    assert all(r.component_id is None for r in found if r.doc_id is None)
    sizes = {i: len(shingles(t)) for i, t in listed}
    assert all(r.n_shingles == sizes[r.doc_id] for r in found)
    left = without_near_duplicates(docs(spark, listed))
    assert {r.doc_id for r in left.select("doc_id").collect()} == {k for k, c in wanted.items() if k == c} | {None}
    assert left.columns == docs(spark, []).columns


def test_frequent_tokens_alone_find_links(spark, monkeypatch):
    """With hardly any token counted as rare, pairs of tokens must find what single ones did."""
    from reportloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "RARE", 1)
    monkeypatch.setattr(ngram_join, "leader_pairs", lambda hits, leader: hits.where("false").selectExpr("d AS a", "d AS b"))
    rng = random.Random(9)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 30, 150, 700]))]
        rows += [" ".join(edited(rng, base, c * max(1, len(base) // 80))) for c in range(3)]
    listed = list(enumerate(rows))
    wanted, links = brute_components(listed)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, listed)).collect()}
    assert links > 10 and found == wanted


def test_join_of_nothing(spark):
    assert near_duplicates(docs(spark, [])).count() == 0 and without_near_duplicates(docs(spark, [])).count() == 0
    assert near_duplicates(docs(spark, [(1, None), (2, "")])).count() == 2
    assert [prefix_length(n) for n in (1, 2, 3, 4, 100)] == [1, 2, 2, 3, 33]


# --- embeddings


def test_vector_links(spark):
    rng = np.random.default_rng(3)
    rows = []
    for label in ("1", "2"):
        for _ in range(40):
            centre = rng.normal(size=24)
            for _ in range(rng.integers(1, 5)):
                rows.append((centre + rng.normal(size=24) * rng.choice([0.02, 0.1, 0.25]), label))
        centre = rng.normal(size=24)
        rows += [(centre + rng.normal(size=24) * 0.08, label) for _ in range(60)]  # lists that fill up
    rows += [rows[0]] * 3 + [(rows[0][0], "2"), (rows[0][0], None), (rows[0][0][:10], "1"), (rows[0][0] * 1e200, "1")]
    listed = [(7 * k + 2, [float(x) for x in v], label, 1, 2) for k, (v, label) in enumerate(rows)]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    listed += [(10_000 + k, v, "1", 1, 2) for k, v in enumerate(odd)] + [(None, listed[0][1], "1", 1, 2)]
    rng.shuffle(listed)
    df = spark.createDataFrame(listed, "vec_id long, embedding array<double>, label string, unit int, grp int")
    out = near_duplicate_vectors(df).collect()
    good = [(i, np.array(v) / np.abs(v).max(), label) for i, v, label, *_ in listed if i is not None and i < 10_000 and label]
    good = [(i, v / np.linalg.norm(v), label) for i, v, label in good]
    links, counts = [], {i: 0 for i, *_ in listed}
    for k, (a, x, p) in enumerate(good):
        for b, y, q in good[:k]:
            if p == q and len(x) == len(y) and x @ y >= 0.98:
                links.append((a, b))
                counts[a] += 1
                counts[b] += 1
    wanted = united({i for i, *_ in listed if i is not None}, links)
    found = {r.vec_id: r for r in out}
    assert len(out) == len(listed) and len(links) > 1000
    total = sum(counts.values())
    assert all(found[i].n_links <= counts[i] for i in counts)
    assert sum(r.n_links for r in out) >= 0.97 * total
    same = sum(found[i].component_id == wanted[i] for i in wanted)
    assert same >= 0.97 * len(wanted)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_an_id_with_several_vectors_keeps_all_classes(spark):
    u1, u2, u3 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(5, u1), (5, u2), (8, u2), (9, u2), (5, u3), (7, u3)]
    df = spark.createDataFrame([(i, v, "1") for i, v in rows], "vec_id long, embedding array<double>, label string")
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect())
    assert out == [(5, 0, 5), (5, 1, 5), (5, 2, 5), (7, 1, 5), (8, 2, 5), (9, 2, 5)]


def test_audit_sees_small_groups_beside_a_hot_one(spark):
    """Every link of the hot group is counted, none of the pairs'; and links are looked for where the first draw holds none."""
    rng = np.random.default_rng(5)
    units = [x / np.linalg.norm(x) for x in rng.normal(size=(400, 24))]
    hot = [np.eye(24)[0] + rng.normal(size=24) * 0.005 for _ in range(200)]
    nodes = [x / np.linalg.norm(x) for x in hot] + [x for x in units for _ in range(2)]
    rows = [(k, 1, 0, x.astype("<f8").tobytes()) for k, x in enumerate(nodes)]
    vectors = spark.createDataFrame(rows, "vec long, copies long, grp long, unit binary")
    found = spark.createDataFrame([(k, 199, True) for k in range(200)], "vec long, links long, dense boolean")
    assert recall(found, vectors) == 0.0
    whole = found.union(spark.createDataFrame([(k, 1, False) for k in range(200, 1000)], "vec long, links long, dense boolean"))
    assert recall(whole, vectors) == 1.0


# --- pipeline and registration


def test_pipeline_stages(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    held = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, SF)
        assert out.columns == given.columns, name
        held = spark.createDataFrame(out.collect(), given.schema)
        assert 0 < held.count(), name
    texts = {r.doc_id: r.text for r in given.collect()}
    left = held.collect()
    assert all(texts[r.doc_id] == r.text for r in left)
    kept = {r.doc_id for r in left}
    wanted, _ = brute_components([(k, texts[k]) for k in kept])
    assert all(k == c for k, c in wanted.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "pack"]


def test_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert ORACLES.keys() <= QUERIES.keys()


def test_toxic_rows_are_dropped_one_by_one(spark):
    """Rows that share an id or have none, a column named like ones of the stage, long texts: each is judged by its own text."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    judged = toxicity(given, labels).join(given.select("doc_id", "text"), "doc_id")
    bad = judged.orderBy(F.desc("score")).first()
    good = judged.where("text <> ''").orderBy("score").first()
    assert bad.score >= 0.7 > good.score
    rows = [(1, bad.text, "a", 7), (1, good.text, "a", 7), (1, good.text, "a", 7), (None, bad.text, None, 7), (None, good.text, None, 7)]
    rows += [(2, None, "a", 7), (3, "", "a", 7), (4, good.text + " word" * 20_000, "a", 7), (5, good.text + " word" * 20_000 + " " + bad.text, "a", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string, rejected_id int")
    both = given.select("doc_id", "text", "source", F.lit(7).alias("rejected_id")).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10**9))
    kept = corpus_pipeline.drop_toxic(spark, both, folder).where("doc_id > 1000000 OR doc_id IS NULL").collect()
    assert kept[0].__fields__ == ["doc_id", "text", "source", "rejected_id"]
    wanted = [(i and i + 10**9, t, s, r) for k, (i, t, s, r) in enumerate(rows) if k not in (0, 3, 8)]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, wanted))


def test_shared_passage_and_rows_that_share_an_id(spark, monkeypatch):
    """A passage that makes up most of many unlike documents gives no candidates; each text of an id has its own links."""
    from reportloom.llm import ngram_join

    rng = random.Random(4)
    fresh = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    passage = fresh(45)
    listed = [(k, " ".join(passage + fresh(rng.randint(10, 16)))) for k in range(400)]
    one, two = fresh(60), fresh(60)
    listed += [(900, " ".join(one)), (900, " ".join(two)), (901, " ".join(one + ["x"])), (902, " ".join(two + ["y"])), (899, " ".join(two))]
    counted = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *more: counted.append(pairs.count()) or verified(pairs, *more))
    found = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, listed)).collect()}
    wanted, _ = brute_components(listed)
    assert found == wanted and {found[k] for k in (899, 900, 901, 902)} == {899}
    assert counted[-1] < 400 and sum(counted) < 1_600


def test_freed_memory_goes_back_to_the_system(monkeypatch):
    """Small objects below one that stays would else be kept for the process, on the driver as in workers."""

    def resident():
        with open("/proc/self/statm") as file:
            return int(file.read().split()[1]) * 4096

    monkeypatch.setattr(common, "_current", "toxicity")
    held = [bytes(2000) for _ in range(60_000)]
    stays, before = held[-1:], resident()
    held.clear()
    common.memory_for("ngram_join")
    assert resident() < before - 60_000 * 1000 and stays


def test_workers_forget_other_operators_and_get_small_batches(spark, monkeypatch):
    common.ship_code(spark)
    rows = spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= 2 * common.BATCH_BYTES
    monkeypatch.setattr(common, "_current", "toxicity")
    tox._features.of(["word"])
    ngram_join.shingle_set("a b c d e f")
    for work in (ngram_join._prefixes, ngram_join._whole_sets, ngram_join._verify):
        list(work(iter([]), 5))
    assert not tox._features.rows and ngram_join._hashes
