"""Packing documents into sequences along a space-filling curve through their hashed vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import memory_for, remembers, ship_code, staged
from reportloom.llm.tokens import WordEncoder

#: Hashed features of a document, dimensions they are projected to, bits of the curve in each.
FEATURES, DIMENSIONS, BITS = 256, 3, 16
#: Bytes of text tokenised together, so that a worker holds the words of few documents at a time; a longer text is alone.
TOGETHER = 1 << 22


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


remembers("packing", lambda: encoder.cache_clear())


@lru_cache(maxsize=1)
def _hashing(ids: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and sign of each token id, and the projection of the buckets; the same in every task."""
    rng = np.random.default_rng(7)
    return (
        rng.integers(0, FEATURES, ids),
        rng.choice([-1.0, 1.0], ids),
        rng.standard_normal((FEATURES, DIMENSIONS)) / np.sqrt(FEATURES),
    )


def project(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Documents, whose tokens stand one after the other, as points: hashed counts, damped, of length one, projected."""
    buckets, signs, onto = _hashing()
    folded = ids & 0xFFFF
    cells = np.repeat(np.arange(len(sizes)) * FEATURES, sizes) + buckets[folded]
    counts = np.bincount(cells, signs[folded], len(sizes) * FEATURES).reshape(-1, FEATURES)
    damped = np.sign(counts) * np.log1p(np.abs(counts))
    size = np.sqrt((damped * damped).sum(1, keepdims=True))
    # Not a matrix product, whose rounding may depend on the other documents.
    return np.einsum("df,fk->dk", damped, onto) / np.where(size == 0, 1, size)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place along the Hilbert curve of points with whole coordinates below 2**bits (rows are points).

    Cell by cell from the largest: a set bit mirrors the lower coordinates of the first axis, a clear one swaps
    them with its own, so that each cell is entered where the one before was left; the bits are then Gray decoded.
    """
    x = points.astype(np.uint64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        q = np.uint64(1 << level)
        low = np.uint64((1 << level) - 1)
        for i in range(axes):
            inside = (x[i] & q) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(level)) & np.uint64(1))
    return place.astype(np.int64)


def _portions(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows that are tokenised together: as many as have at most ``TOGETHER`` bytes, at least one."""
    ends, begin = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield begin, end - begin
        begin = end


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    memory_for("packing")
    model = encoder(path)
    for batch in batches:
        for begin, rows in _portions(batch.column("text")):
            part = batch.slice(begin, rows)
            ids, sizes = model.batch(part.column("text"))
            ids = np.insert(ids, np.cumsum(sizes), end_id)
            sizes = sizes + 1
            ends = np.append(0, np.cumsum(sizes)) * ids.itemsize
            raw = ids.tobytes()
            found = [raw[a:b] for a, b in pairwise(ends.tolist())]
            points = project(ids, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("row"),
                    pa.array(sizes, pa.int64()),
                    pa.array(map(zlib.crc32, found), pa.int64()),
                    pa.array(found, pa.binary()),
                    *(pa.array(points[:, d]) for d in range(DIMENSIONS)),
                ],
                names=["doc_id", "row", "n", "crc", "ids", *(f"p{d}" for d in range(DIMENSIONS))],
            )


def _curve_keys(batches: Iterator[pa.RecordBatch], means: list[float], spreads: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.stack([batch.column(f"p{d}").to_numpy(zero_copy_only=False) for d in range(DIMENSIONS)], 1)
        # The corpus' mean and spread put the bulk of the points evenly over the cube.
        even = 1 / (1 + np.exp(-1.7 * (points - np.array(means)) / np.array(spreads)))
        cells = np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n"), batch.column("crc"), pa.array(hilbert(cells))],
            names=["row", "n", "crc", "key"],
        )


def _running_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each document of a sorted partition begins within it."""
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        ends = np.cumsum(batch.column("n").to_numpy()) + before
        starts = np.concatenate([[before], ends[:-1]]) if len(ends) else ends
        before = int(ends[-1]) if len(ends) else before
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("n"), pa.array(np.full(len(ends), part), pa.int64()), pa.array(starts, pa.int64())],
            names=["row", "n", "part", "start"],
        )


def tail_lengths(rest: int) -> list[int]:
    """The last words of the corpus, fewer than a sequence: lengths that are powers of two and so need no padding."""
    return [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def _cut(batches: Iterator[pa.RecordBatch], length: int, total: int, width: int) -> Iterator[pa.RecordBatch]:
    kind = np.dtype(f"<u{width}")
    full = total // length
    tail = np.cumsum([full * length, *tail_lengths(total - full * length)])
    for batch in batches:
        out: list[tuple] = []
        for doc, ids, place in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "place")), strict=True):
            numbers = np.frombuffer(ids, kind).astype("<u4")
            done = 0
            while done < len(numbers):
                at = place + done
                if at < full * length:
                    sequence, offset, room = at // length, at % length, length - at % length
                else:
                    i = int(np.searchsorted(tail, at, "right")) - 1
                    sequence, offset, room = full + i, at - int(tail[i]), int(tail[i + 1]) - at
                piece = numbers[done : done + room].tobytes()
                out.append((doc, done, len(piece) // 4, zlib.crc32(piece), len(numbers), sequence, offset, piece))
                done += len(piece) // 4
        columns = list(zip(*out, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], batch.column("doc_id").type)]
            + [pa.array(c, pa.int64()) for c in columns[1:7]]
            + [pa.array(columns[7], pa.binary())],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    length: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of ``length`` tokens, neighbours on the Hilbert curve side by side.

    Every document is tokenised whole and gets ``end_id`` after its tokens. Its hashed token counts are projected
    to three dimensions, its place on the Hilbert curve through them is the key of a range sort (then a checksum of its
    tokens and its row number, so copies of one text can be spread over tasks), and the documents in that order form
    one run of tokens that is cut every ``length``. A document may be cut at any token. The last, incomplete
    sequence is cut into lengths that are powers of two, so nothing is padded at all.

    Only one total for each partition meets in one task; tokens are written once, and moved once
    to meet their places. Null or empty text is a document of the end token alone; repeated rows are documents of their own;
    a null id is kept; an empty table gives no pieces; other columns are not looked at. Returns one row for each
    piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, ``ids`` (unsigned
    little-endian 32-bit numbers).
    """
    spark = docs.sparkSession
    ship_code(spark)
    key_type = docs.select(docs[id_col].alias("doc_id")).schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    )
    points = [f"p{d}" for d in range(DIMENSIONS)]
    tokens = staged(
        rows.mapInArrow(
            lambda batches: _tokenise(batches, tokenizer_path, end_id),
            f"doc_id {key_type}, row long, n long, crc long, ids binary, " + ", ".join(f"{p} double" for p in points),
        ),
        "pack-tokens",
    )
    moments = tokens.agg(*(f(p).alias(f"{f.__name__}_{p}") for p in points for f in (F.avg, F.stddev_pop))).first()
    means = [moments[f"avg_{p}"] or 0.0 for p in points]
    spreads = [moments[f"stddev_pop_{p}"] or 1.0 for p in points]
    keyed = tokens.select("row", "n", "crc", *points).mapInArrow(
        lambda batches: _curve_keys(batches, means, spreads), "row long, n long, crc long, key long"
    )
    order = ["key", "crc", "row"]
    placed = staged(
        staged(keyed, "pack-keys").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(
            _running_starts, "row long, n long, part long, start long"
        ),
        "pack-places",
    )
    parts = placed.groupBy("part").agg(F.sum("n").alias("held"))
    base = F.sum("held").over(Window.orderBy("part")) - F.col("held")
    parts = parts.select("part", "held", base.alias("base"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    places = placed.join(parts, "part").select("row", (F.col("base") + F.col("start")).alias("place"))
    width = 2 if encoder(tokenizer_path).code == "H" else 4
    return tokens.select("row", "doc_id", "ids").join(places, "row").select("doc_id", "ids", "place").mapInArrow(
        lambda batches: _cut(batches, length, total, width),
        f"doc_id {key_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` (32-bit numbers) and the ``doc_ids`` in them, in order.

    A sequence holds at most as many pieces as tokens, so what is gathered for it is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
    )
