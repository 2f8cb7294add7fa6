"""Scoring texts by prediction by partial matching: a byte-context trie with escapes and symbol exclusion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import crc_bucket, ship_code, staged
from reportloom.plans.staging import dropped_afterwards

#: Symbols before the one that is predicted; classes of bytes that contexts are made of.
ORDER, CLASSES = 4, 32
#: Contexts are handed over in blocks by their last two symbols.
BLOCKS = CLASSES**2
#: Bytes scored or counted together; bytes of a chunk of documents that shares a dictionary; words a worker remembers.
TOGETHER, CHUNK, REMEMBERED = 1 << 20, 12 << 20, 200_000
#: With whole bytes, bytes of a chunk: the fewer chunks, the fewer rows ask for the same contexts and words. How its texts travel.
WHOLE_CHUNK = 32 << 20
_PACKING = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))

_SCHEMA = {
    "chunk": "long", "key": "long", "place": "int", "train": "long", "doc_id": "long", "held_out": "boolean",
    "places": "array<int>", "times": "array<int>", "score": "double", "cell": "long", "text": "binary",
}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
_ARROW = {name: _KINDS[kind] for name, kind in _SCHEMA.items()}
#: Rows of a chunk that leave the worker in one batch.
ROWS = 1 << 15
#: A context's or a gram's number of bytes stands above its bytes in a cell.
ABOVE = 40


@lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    """Class of each byte: white space, the 26 letters, digits, marks, other signs, continuation and lead bytes."""
    out = np.full(256, 29, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    for k in range(26):
        out[[65 + k, 97 + k]] = 1 + k
    out[48:58] = 27
    out[list(b".,;:!?'\"-")] = 28
    out[128:192] = 30
    out[192:] = 31
    return out


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: bytes, their classes, the code of each context with its symbol, which bytes are real.

    A text begins after ORDER symbols of white space; codes hold the oldest symbol first.
    """
    pad = b" " * ORDER
    joined = np.frombuffer(pad + pad.join(texts), np.uint8)
    kinds = byte_classes()[joined].astype(np.int32)
    codes = np.zeros(len(joined), np.int32)
    for back in range(ORDER, -1, -1):
        codes[ORDER:] = codes[ORDER:] * CLASSES + kinds[ORDER - back : len(kinds) - back]
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + ORDER)
    real = np.ones(len(joined), bool)
    for k in range(ORDER):
        real[(ends - lengths - ORDER + k)] = False
    return joined, kinds, codes, real


def _rounds(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, some at a time, with the place of the first; few are turned into Python objects at once."""
    begin, texts, held = 0, [], 0
    for at in range(0, batch.num_rows, 64):
        for text in batch.column("text").slice(at, 64).cast(pa.binary()).to_pylist():
            texts.append(text)
            held += len(text)
            if held >= TOGETHER:
                yield begin, texts
                begin, texts, held = begin + len(texts), [], 0
    if texts:
        yield begin, texts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the trie's leaves (context and symbol) and of bytes after the class before, one row per cell and task's round."""
    for batch in batches:
        for _, texts in _rounds(batch):
            joined, kinds, codes, real = _contexts(texts)
            leaves, n = np.unique(codes[real], return_counts=True)
            before = np.concatenate([[0], kinds[:-1]])
            pairs, m = np.unique((before * 256 + joined)[real], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.ones(len(leaves), bool), np.zeros(len(pairs), bool)])),
                    pa.array(np.concatenate([leaves, pairs]).astype(np.int64)), pa.array(np.concatenate([n, m])),
                ],
                names=["leaf", "cell", "n"],
            )


def escape_levels(counts: list[np.ndarray]) -> np.ndarray:
    """Probabilities of all symbols after all contexts of the longest order, from counts of every order.

    ``counts[k]`` has the shape (contexts of the k last symbols, symbols); the contexts of one block share their last
    symbols, so an order's row is found by the code's remainder. Of the total each distinct symbol gives half a count to
    the escape. After an escape the symbols already seen in the longer context are excluded from the shorter one's
    total and escape; below the empty context what is left is shared evenly.
    A context that was never seen passes on to the next shorter one for nothing.
    """
    top = len(counts) - 1
    rows = len(counts[top])
    out = np.zeros((rows, CLASSES))
    left = np.ones((rows, 1))
    open_ = np.ones((rows, CLASSES), bool)
    for k in range(top, -1, -1):
        level = counts[k]
        level = level[np.arange(rows) % len(level)] * open_
        total, distinct = level.sum(1, keepdims=True), (level > 0).sum(1, keepdims=True)
        more = (open_ & (level == 0)).any(1, keepdims=True)
        share = np.divide(left, total, out=np.zeros_like(left), where=total > 0)
        # Where nothing is left to escape to, the whole mass is the seen symbols'.
        out += share * np.where(more, np.maximum(level - 0.5, 0), level)
        left = np.where(total > 0, share * np.where(more, 0.5 * distinct, 0), left)
        open_ &= level == 0
    rest = open_.sum(1, keepdims=True)
    return out + np.divide(left, rest, out=np.zeros_like(left), where=rest > 0) * open_


def _block(block: int, codes: np.ndarray, n: np.ndarray, low: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Code lengths of a block: contexts that end with its two symbols. ``low``: counts of orders 0 and 1.

    Gives the longest contexts that were seen, their code lengths, and those of all contexts one symbol shorter.
    """
    inner = CLASSES ** (ORDER - 2)
    # A leaf's code is (older symbols, block, symbol).
    older, symbol = codes // (BLOCKS * CLASSES), codes % CLASSES
    leaves = np.zeros((inner, CLASSES), np.int64)
    np.add.at(leaves, (older, symbol), n)
    counts = [low[0], low[1][block % CLASSES : block % CLASSES + 1]]
    for k in range(2, ORDER + 1):
        counts.append(leaves.reshape(-1, CLASSES ** (k - 2), CLASSES).sum(0))
    seen = np.flatnonzero(leaves.any(1))
    return seen, code_lengths(escape_levels(counts)[seen]), code_lengths(escape_levels(counts[:-1]))


def code_lengths(p: np.ndarray) -> np.ndarray:
    """-log10 of probabilities in steps of 1/8192, at most 8; two bytes each keep the model small."""
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-30)) * 8192), 65535).astype(np.uint16)


class Model:
    """The trained trie as one table: a row of code lengths for each context seen, and for all that are one symbol shorter.

    ``rows_of`` leads from each longest context to its row, or to that of its shorter one where it was never seen, which
    says the same at no cost.
    """

    def __init__(self, rows_of: np.ndarray, lengths: np.ndarray, in_class: np.ndarray):
        self.rows_of, self.lengths, self.in_class = rows_of, lengths, in_class

    def scores(self, texts: list[bytes]) -> np.ndarray:
        joined, kinds, codes, real = _contexts(texts)
        before = np.concatenate([[0], kinds[:-1]])
        symbols = self.lengths[self.rows_of[codes // CLASSES] * CLASSES + codes % CLASSES] / -8192.0
        each = (symbols + self.in_class[before * 256 + joined]) * real
        lengths = np.array([len(t) + ORDER for t in texts], np.int64)
        return np.add.reduceat(each, np.cumsum(lengths) - lengths)


def train(texts: DataFrame) -> Model:
    """Count every byte context of all texts and turn the counts into the model's tables.

    Counting is partial in each task and summed by Spark. The trie has at most 32**4 longest contexts by its construction,
    whatever the corpus: its table is built block by block in tasks and comes to the driver as 1024 rows of at most 70 KB.
    """
    counted = staged(
        texts.select("text").mapInArrow(_count, "leaf boolean, cell long, n long")
        .groupBy("leaf", "cell").agg(F.sum("n").alias("n")), "ppm-counts",
    )
    symbol = F.col("cell") % CLASSES
    last = (F.floor(F.col("cell") / CLASSES) % CLASSES).cast("long")
    one = np.zeros((CLASSES, CLASSES), np.int64)
    for row in counted.where("leaf").groupBy(last.alias("c"), symbol.alias("s")).agg(F.sum("n").alias("n")).collect():
        one[row["c"], row["s"]] = row["n"]
    low = [one.sum(0, keepdims=True), one]
    ahead = np.zeros(CLASSES * 256, np.int64)
    for row in counted.where("NOT leaf").collect():  # at most 32 * 256 cells
        ahead[row["cell"]] = row["n"]

    def build(key, group):
        block = key[0].as_py()
        codes, n = (group.column(c).to_numpy() for c in ("cell", "n"))
        real = codes >= 0
        seen, own, shorter = _block(block, codes[real], n[real], low)
        parts = [part.tobytes() for part in (seen.astype(np.int32), own, shorter)]
        return pa.table([pa.array([block], pa.int64()), *(pa.array([part], pa.binary()) for part in parts)], names=["block", "seen", "own", "shorter"])

    spark = texts.sparkSession
    block = (F.floor(F.col("cell") / CLASSES) % BLOCKS).cast("long")
    # Every block has a row, so that contexts never seen have their tables too.
    every = spark.range(BLOCKS).select(F.col("id").alias("block"), F.lit(-1).cast("long").alias("cell"), F.lit(0).cast("long").alias("n"))
    cells = counted.where("leaf").select(block.alias("block"), "cell", "n").union(every)
    # Small partitions, so that what is on its way to the driver at once is little.
    built = cells.groupBy("block").applyInArrow(build, "block long, seen binary, own binary, shorter binary").repartition(32)
    shorter = CLASSES ** (ORDER - 1)
    rows_of = np.tile(np.arange(shorter, dtype=np.int32), CLASSES)
    base = np.empty((shorter // BLOCKS, BLOCKS, CLASSES), np.uint16)
    own, placed = [], shorter
    for row in built.toLocalIterator(prefetchPartitions=True):
        base[:, row["block"]] = np.frombuffer(row["shorter"], np.uint16).reshape(-1, CLASSES)
        seen = np.frombuffer(row["seen"], np.int32)
        rows_of[seen.astype(np.int64) * BLOCKS + row["block"]] = np.arange(placed, placed + len(seen))
        own.append(np.frombuffer(row["own"], np.uint16))
        placed += len(seen)
    lengths = np.concatenate([base.reshape(-1), *own])
    # A byte within its class, by the class before, with half a count for each byte of the class.
    kinds = byte_classes()
    halves = ahead.reshape(CLASSES, 256) + 0.5
    totals = np.stack([np.bincount(kinds, weights=row, minlength=CLASSES) for row in halves])
    return Model(rows_of, lengths, np.log10(halves / totals[:, kinds]).reshape(-1))


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of texts laid end to end as for the classes: each byte after the ORDER bytes before it, oldest first; which are real."""
    pad = b" " * ORDER
    joined = np.frombuffer(pad + pad.join(texts), np.uint8).astype(np.int64)
    grams = np.zeros(len(joined), np.int64)
    for back in range(ORDER, -1, -1):
        grams[ORDER:] = grams[ORDER:] << 8 | joined[ORDER - back : len(joined) - back]
    lengths = np.array([len(t) for t in texts], np.int64) + ORDER
    real = np.ones(len(joined), bool)
    for k in range(ORDER):
        real[np.cumsum(lengths) - lengths + k] = False
    return grams, real


def _cells(order: int, grams: np.ndarray) -> np.ndarray:
    """The contexts of ``order`` bytes that stand before the grams' last bytes."""
    return (grams >> 8 & (1 << 8 * order) - 1) | order << ABOVE


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sum of each one's numbers."""
    order = np.argsort(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[begins], np.add.reduceat(n[order], begins) if len(begins) else n[:0]


def _counted(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different grams in order, and how often each one is a training text's."""
    parts = [np.unique(grams[where], return_counts=True) for where in (train, ~train)]
    return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([parts[0][1], np.zeros_like(parts[1][1])]))


def _gram_cells(grams: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a chunk: its grams with their counts in training texts, and its contexts of every order with 0."""
    known, counts = _summed(grams, train)
    contexts = np.concatenate([np.unique(_cells(k, known)) for k in range(ORDER + 1)])
    cells = np.concatenate([known[counts > 0] | ORDER + 1 << ABOVE, contexts])
    return cells, np.concatenate([counts[counts > 0], np.zeros(len(contexts), np.int64)])


class Contexts:
    """Rows of a corpus' contexts, as one chunk needs them, for prediction with escapes and exclusion.

    What was seen after a context was also seen after every shorter one. So the symbols excluded at an order are those in the row of the
    context one byte longer, and an order's remaining total is its own less what it counts for these.
    """

    def __init__(self, cells: np.ndarray, lengths: np.ndarray, packed: np.ndarray):
        entries = np.repeat(cells, lengths) << 8 | packed & 255
        order = np.argsort(entries)
        entries, n = entries[order], (packed >> 8)[order]
        ids, begins, distinct = np.unique(entries >> 8, return_index=True, return_counts=True)
        orders = entries >> 8 + ABOVE
        shorter = (orders - 1 << ABOVE | (entries >> 8) & (1 << 8 * np.maximum(orders - 1, 0)) - 1) << 8 | entries & 255
        passed = np.where(orders > 0, n[np.minimum(np.searchsorted(entries, shorter), max(len(n) - 1, 0))], 0) if len(n) else n
        sums = [np.add.reduceat(x, begins) if len(x) else x for x in (n, passed)]
        # One more context that nothing asks for, so that every search ends on one.
        self.ids, self.entries = np.append(ids, 1 << 62), np.append(entries, 1 << 62)
        self.n, self.distinct, self.total, self.passed = (np.append(x, 0) for x in (n, distinct, *sums))

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the probabilities of the grams' last bytes after those before."""
        p, left, told = np.zeros(len(grams)), np.ones(len(grams)), np.zeros(len(grams), bool)
        out_total, out_distinct = (np.zeros(len(grams), np.int64) for _ in range(2))
        for k in range(ORDER, -1, -1):
            cells = _cells(k, grams)
            at = np.searchsorted(self.ids, cells)
            found = self.ids[at] == cells
            distinct = np.where(found, self.distinct[at], 0)
            total = np.where(found, self.total[at], 0) - out_total
            share = np.divide(left, total, out=np.zeros(len(grams)), where=total > 0)
            place = np.searchsorted(self.entries, cells << 8 | grams & 255)
            hit = (self.entries[place] == cells << 8 | grams & 255) & ~told
            more = distinct < 256
            p = np.where(hit, share * (self.n[place] - 0.5 * more), p)
            left = np.where(total > 0, share * 0.5 * (distinct - out_distinct) * more, left)
            told |= hit
            out_total, out_distinct = np.where(found, self.passed[at], 0), distinct
        return np.log10(np.where(told, p, left / np.maximum(256 - out_distinct, 1)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        grams, real = _grams(texts)
        at, known = pd.factorize(grams)
        # Sorted, they are searched for side by side.
        order = np.argsort(known)
        logs = np.empty(len(known))
        logs[order] = self.logs(known[order])
        lengths = np.array([len(t) + ORDER for t in texts], np.int64)
        return np.add.reduceat(logs[at] * real, np.cumsum(lengths) - lengths)


def _corpus_rows(cells: DataFrame) -> DataFrame:
    """Every context of the training texts (``cell``) and its ``row``: at most 256 counts, each above its symbol's byte."""
    below = F.lit((1 << ABOVE) - 1).cast("long")
    grams = cells.where("train > 0").select(F.col("cell").bitwiseAND(below).alias("gram"), "train")
    grams = staged(grams.groupBy("gram").agg(F.sum("train").alias("n")), "ppm-grams")
    entries = F.array(*(
        F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("long")) + F.lit(k << ABOVE + 8).cast("long") for k in range(ORDER + 1)
    ))
    counted = grams.select(F.explode(entries).alias("entry"), "n").groupBy("entry").agg(F.sum("n").alias("n"))
    packed = F.shiftleft("n", 8) + F.col("entry").bitwiseAND(F.lit(255).cast("long"))
    return counted.groupBy(F.shiftright("entry", 8).alias("cell")).agg(F.collect_list(packed).alias("row"))


class WordKeys(dict):
    """64-bit hashes of words, remembered by the worker; the empty word stands for a text's end."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_keys = WordKeys()
_END = np.array([xxhash.xxh64_intdigest(b"")], np.uint64)


def word_keys(text: bytes) -> np.ndarray:
    """Keys of a text's words, A-Z lower-cased, and of its end."""
    words = text.lower().split()
    return np.concatenate([np.fromiter(map(_keys.__getitem__, words), np.uint64, len(words)), _END])


class Words:
    """The words of a chunk's documents, A-Z lower-cased, and their ends, each word's string looked at once."""

    def __init__(self) -> None:
        self.rounds: list[pa.DictionaryArray] = []
        self.counts: list[int] = []

    def add(self, texts: list[bytes]) -> None:
        found = [[*text.lower().split(), b""] for text in texts]
        self.counts += map(len, found)
        self.rounds.append(pa.array([word for words in found for word in words], pa.binary()).dictionary_encode())

    def placed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Different words' keys in order, each word's place among them, and each document's number of words."""
        coded = pa.chunked_array(self.rounds).unify_dictionaries()
        strings = coded.chunk(0).dictionary
        keys = np.fromiter((xxhash.xxh64_intdigest(word.as_buffer()) for word in strings), np.uint64, len(strings))
        known, places = np.unique(keys, return_inverse=True)
        at = np.concatenate([some.indices.to_numpy() for some in coded.chunks])
        return known, places.astype(np.int32)[at], np.array(self.counts, np.int64)


def _trained(places: np.ndarray, counts: np.ndarray, held: np.ndarray, known: int) -> np.ndarray:
    """How often each of the known words stands in training texts."""
    return np.bincount(places[np.repeat(~held, counts)], minlength=known)


def _packed(docs: pa.Array, held: list[bool], texts: list[bytes]) -> bytes:
    """Some documents as one value, compressed."""
    batch = pa.record_batch([docs, pa.array(held, pa.bool_()), pa.array(texts, pa.binary())], names=["doc_id", "held_out", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_PACKING) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _parts(chunk: int, columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of one kind with nulls in the other kinds' columns, some at a time, as a chunk in one batch would be large."""
    n = len(next(iter(columns.values())))
    for at in range(0, n, ROWS):
        rows = min(ROWS, n - at)
        made = {
            name: columns[name].slice(at, rows) if name in columns else pa.nulls(rows, kind) for name, kind in _ARROW.items()
        } | {"chunk": pa.array(np.full(rows, chunk, np.int64))}
        yield pa.RecordBatch.from_arrays([made[name] for name in _ARROW], names=list(_ARROW))


def _chunk_rows(
    chunk: int, keys: list[np.ndarray], held: list[bool], docs: pa.Array, scores: pa.Array, cells: tuple[np.ndarray, np.ndarray], texts: pa.Array
) -> Iterator[pa.RecordBatch]:
    """A chunk's dictionary (key, place, how often its training texts hold it), its documents (places, times), its cells."""
    yield from _parts(chunk, {"train": pa.array(cells[1]), "cell": pa.array(cells[0])})
    lengths = np.array([len(k) for k in keys], np.int64)
    known, places = np.unique(np.concatenate(keys), return_inverse=True)
    train = np.bincount(places[~np.repeat(np.array(held, bool), lengths)], minlength=len(known))
    words = {"key": known.view(np.int64), "place": np.arange(len(known), dtype=np.int32), "train": train.astype(np.int64)}
    yield from _parts(chunk, {name: pa.array(values) for name, values in words.items()})
    places += np.repeat(np.arange(len(keys)) * len(known), lengths)
    pairs, times = np.unique(places, return_counts=True)
    del places
    ends = np.searchsorted(pairs, np.arange(len(keys) + 1) * len(known)).astype(np.int32)
    at = pa.ListArray.from_arrays(ends, pa.array((pairs % len(known)).astype(np.int32)))
    how = pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))
    yield from _parts(
        chunk, {"doc_id": docs, "held_out": pa.array(held, pa.bool_()), "places": at, "times": how, "score": scores, "text": texts}
    )


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of consecutive documents: cells, the words' dictionary, and the documents with their texts, packed some together."""
    base, seq = TaskContext.get().partitionId() << 32, 0

    def done() -> Iterator[pa.RecordBatch]:
        cells, n = _gram_cells(*map(np.concatenate, zip(*grams, strict=True)))
        yield from _parts(base + seq, {"train": pa.array(n), "cell": pa.array(cells)})
        known, places, counts = words.placed()
        train = _trained(places, counts, np.array(held, bool), len(known))
        places = np.arange(len(known), dtype=np.int32)
        yield from _parts(base + seq, {"key": pa.array(known.view(np.int64)), "place": pa.array(places), "train": pa.array(train)})
        for text in texts:
            yield from _parts(base + seq, {"text": pa.array([text], pa.binary())})

    words, grams, held, texts, size = Words(), [], [], [], 0
    for batch in batches:
        for at, some in _rounds(batch):
            own = batch.column("held_out").slice(at, len(some)).to_pylist()
            words.add(some)
            held += own
            codes, real = _grams(some)
            grams.append(_counted(codes[real], np.repeat(~np.array(own, bool), [len(text) for text in some])))
            texts.append(_packed(batch.column("doc_id").slice(at, len(some)), own, some))
            size += sum(map(len, some))
            if size >= WHOLE_CHUNK:
                yield from done()
                words, grams, held, texts, size, seq = Words(), [], [], [], 0, seq + 1
    if texts:
        yield from done()


def _chunks(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Chunks of consecutive documents: their words' dictionary and the documents with their model scores."""
    base, seq = TaskContext.get().partitionId() << 32, 0
    keys: list[np.ndarray] = []
    held: list[bool] = []
    docs: list[pa.Array] = []
    scores: list[pa.Array] = []
    size = 0

    def done() -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 2
        yield from _chunk_rows(base + seq, keys, held, pa.concat_arrays(docs), pa.concat_arrays(scores), none, pa.nulls(len(keys), pa.binary()))

    for batch in batches:
        for at, some in _rounds(batch):
            keys += [word_keys(text) for text in some]
            held += batch.column("held_out").slice(at, len(some)).to_pylist()
            docs.append(batch.column("doc_id").slice(at, len(some)))
            scores.append(pa.array(shared.value.scores(some), pa.float64()))
            size += sum(map(len, some))
            if size >= CHUNK:
                yield from done()
                keys, held, docs, scores, size, seq = [], [], [], [], 0, seq + 1
    if keys:
        yield from done()


def score_texts(
    docs: DataFrame, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", whole_bytes: bool = False
) -> DataFrame:
    """log10 probabilities of all whole texts by the pretrained byte model, and by word counts for comparison.

    Both learn from every document whose crc32 of the id's text modulo ``folds`` is not ``held_out``. The model
    is prediction by partial matching over contexts of up to four byte classes (32 classes, so that the trie has a size
    bound by its construction): a symbol not seen after the longest context costs an escape (its estimate: distinct symbols
    over total and distinct), and shorter contexts exclude the symbols already passed over. A byte costs its class, then itself
    within the class by the class before. ``score`` is the sum over a text's bytes, a proper probability.

    With ``whole_bytes`` the symbols are the 256 bytes and the contexts up to four real bytes, as many as the corpus has. Each chunk of
    documents sends its counts and the list of its contexts, and gets back the corpus' rows of these, as it does for words;
    no model is broadcast, and code lengths are doubles. Texts travel compressed and are cut into words anew, which is less than their
    words' places would be; of words a chunk gets the counts that others add to.

    ``base_score`` sums ``log10((c + 0.5) / (N + 0.5 (V + 1)))`` over the words (A-Z lower-cased) and one end of text. Word counts
    are no table that could be broadcast: each chunk of documents sends its dictionary to meet the corpus' counts, every word
    once, and gets back its own part. Words meet by 64-bit hashes.

    Null text counts as empty (its one token is the end; its ``score`` is 0); a null id's remainder is that of empty text; repeated
    rows are rows of their own; without training documents all counts are 0 and every byte is as likely as its class allows; an
    empty table gives an empty table; other columns are not looked at. Returns ``doc_id``, ``held_out``, ``n_tokens``,
    ``n_known``, ``train_tokens``, ``base_score``, ``score``.
    """
    spark = docs.sparkSession
    ship_code(spark)
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        (crc_bucket(docs[id_col], folds) == held_out).alias("held_out"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    shared = None
    if not whole_bytes:
        with dropped_afterwards(spark):
            shared = spark.sparkContext.broadcast(train(rows.where("NOT held_out").select("text")))
    kinds = ", ".join(f"{name} {kind}" for name, kind in _SCHEMA.items())
    make = _whole_chunks if whole_bytes else lambda batches: _chunks(batches, shared)
    chunks = staged(rows.mapInArrow(make, kinds), "ppm-chunks")
    # Each word's rows, one a chunk at most, meet in one exchange.
    same = Window.partitionBy("key")
    words = chunks.where("key IS NOT NULL").select(
        F.col("chunk").alias("own_chunk"), "place", "train", F.sum("train").over(same).alias("c"),
        (F.col("chunk") == F.min("chunk").over(same)).alias("first"),
    )
    # A chunk that has its texts knows its own counts; it needs those that others add to.
    told = (F.col("c") != F.col("train")) if whole_bytes else F.lit(True)
    words = staged(words.select("own_chunk", "place", "c", "first", told.alias("told")).where("first OR told"), "ppm-words")
    totals = words.where("first").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    all_tokens, floor = totals["n"], totals["n"] + 0.5 * (totals["v"] + 1)
    mine = words.where("told").select("own_chunk", "place", "c")
    made = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def table(ids, held, sums: list[np.ndarray], score) -> pa.Table:
        columns = [
            ids, held, pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
            pa.array(np.full(len(ids), all_tokens, np.int64)), pa.array(sums[2].astype(np.float64)), score,
        ]
        return pa.table(columns, names=[field.split()[0] for field in made.split(", ")])

    def by_places(documents, dictionary):
        c = np.zeros(len(dictionary), np.int64)
        c[dictionary.column("place").to_numpy()] = dictionary.column("c").to_numpy()
        logs = np.log10((c + 0.5) / floor)
        places = documents.column("places").combine_chunks().flatten().to_numpy()
        times = documents.column("times").combine_chunks().flatten().to_numpy()
        lengths = pc.list_value_length(documents.column("places")).to_numpy()
        begins = np.cumsum(lengths) - lengths
        summed = [np.add.reduceat(x, begins) if len(x) else np.zeros(0) for x in (times, times * (c[places] > 0), times * logs[places])]
        return table(documents.column("doc_id"), documents.column("held_out"), summed, documents.column("score"))

    def by_texts(packed, dictionary):
        asked = dictionary.filter(pc.is_valid(dictionary.column("cell")))
        rows_of = asked.column("row").combine_chunks()
        model = Contexts(asked.column("cell").to_numpy(), pc.list_value_length(rows_of).to_numpy(), rows_of.flatten().to_numpy())
        found, heads, scores = Words(), [], []
        for one in packed.column("text"):
            documents = pa.ipc.open_stream(one.as_buffer()).read_all()
            texts = documents.column("text").to_pylist()
            found.add(texts)
            scores.append(model.scores(texts))
            heads.append(documents.drop_columns("text"))
        head = pa.concat_tables(heads)
        known, places, counts = found.placed()
        c = _trained(places, counts, head.column("held_out").to_numpy(), len(known))
        dictionary = dictionary.filter(pc.is_valid(dictionary.column("place")))
        c[dictionary.column("place").to_numpy()] = dictionary.column("c").to_numpy()
        begins = np.cumsum(counts) - counts
        sums = [counts, np.add.reduceat((c > 0)[places], begins, dtype=np.int64), np.add.reduceat(np.log10((c + 0.5) / floor)[places], begins)]
        return table(head.column("doc_id"), head.column("held_out"), sums, pa.array(np.concatenate(scores)))

    texts = chunks.where("key IS NULL AND cell IS NULL")
    if not whole_bytes:
        texts = texts.select("chunk", "doc_id", "held_out", "places", "times", "score")
        return texts.groupBy("chunk").cogroup(mine.groupBy("own_chunk")).applyInArrow(by_places, made)
    cells = chunks.where("cell IS NOT NULL").select("chunk", "cell", "train")
    asked = cells.where("train = 0").select(F.col("chunk").alias("own_chunk"), "cell").join(_corpus_rows(cells), "cell")
    mine = mine.unionByName(asked, allowMissingColumns=True)
    return texts.select("chunk", "text").groupBy("chunk").cogroup(mine.groupBy("own_chunk")).applyInArrow(by_texts, made)
