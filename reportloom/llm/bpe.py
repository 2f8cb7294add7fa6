"""Byte-level BPE: encoding by a segment tree over the ranks of adjacent pairs, and decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from reportloom.llm.common import ship_code

#: Unicode's white space, and (below) how the vocabulary's tokenizer cuts a text into pieces.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _piece(letters: str, digits: str) -> str:
    return (
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{SPACES}{letters}{digits}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
    )


#: Pieces a worker remembers (twice as many at most), and the longest of them in characters; bounds its memory, changes no result.
REMEMBERED, REMEMBERED_CHARS = 250_000, 64
#: Bytes from which a piece is merged alone, and shorter pieces merged together.
LONG_PIECE, ROWS = 64, 1 << 13
#: Bytes of text or ids that a worker holds as Python objects at once (a longer text is held alone).
TOGETHER = 4 << 20


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in such vocabularies: Latin-1's own, and code points from 256 for the rest."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in own}
    others = [b for b in range(256) if chr(b) not in letters]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


def merged(ids: list[int], ranks: dict[tuple[int, int], int], results: Sequence[int]) -> list[int]:
    """The ids after all merges: each time the leftmost pair of the lowest rank becomes one, until no pair has a rank.

    ``ranks`` gives a pair's rank, ``results`` the id that the merge of a rank makes. A segment tree holds, for the place of
    every pair's left symbol, rank and place as one number, and in each inner node the smaller of its two; so the
    root is the next merge, and a merge changes three leaves and their ways up: n log n for n symbols.
    """
    n = len(ids)
    if n < 2:
        return ids
    none = len(results) * n
    size = 1 << (n - 2).bit_length()
    tree = [none] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get((ids[i], ids[i + 1]))
        if rank is not None:
            tree[size + i] = rank * n + i
    for node in range(size - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, value: int) -> None:
        node = size + place
        tree[node] = value
        while node > 1:
            other = tree[node ^ 1]
            node >>= 1
            value = value if value < other else other
            if tree[node] == value:
                return
            tree[node] = value

    while tree[1] < none:
        rank, place = divmod(tree[1], n)
        gone = after[place]
        ids[place] = made = results[rank]
        ids[gone] = -1
        follower = after[place] = after[gone]
        if gone < n - 1:
            put(gone, none)
        rank = None
        if follower < n:
            before[follower] = place
            rank = get((made, ids[follower]))
        put(place, none if rank is None else rank * n + place)
        if place:
            leader = before[place]
            rank = get((ids[leader], made))
            put(leader, none if rank is None else rank * n + leader)
    return [i for i in ids if i >= 0]


class PairTable:
    """Ranks of adjacent pairs, looked up for whole arrays, and the ids that their merges make."""

    def __init__(self, ranks: dict[tuple[int, int], int], results: Sequence[int]):
        self.ranks, self.results = ranks, list(results)
        self.width = 1 + max([0, *self.results, *(i for pair in ranks for i in pair)])
        keys = np.array([a * self.width + b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.array(list(ranks.values()), np.int64)[order]
        self.made = np.array(self.results, np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs; the number of merges where a pair has none or one side is negative."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.key_ranks[at], len(self.results))


def merged_rows(symbols: np.ndarray, table: PairTable) -> np.ndarray:
    """``merged`` for many short pieces at once: rows of ids with -1 behind their ends, one segment tree a row.

    Each round takes the next merge off the root of every tree that has one. Returns the rows with -1 where a symbol went
    into its neighbour. Rows have a power of two plus one columns.
    """
    rows, columns = symbols.shape
    size = columns - 1
    shift, none = size.bit_length() - 1, len(table.results) << (size.bit_length() - 1)
    ids = np.concatenate([symbols, np.full((rows, 1), -1)], 1).astype(np.int64)
    tree = np.empty((rows, 2 * size), np.int64)
    tree[:, size:] = (table.of(ids[:, :size], ids[:, 1:columns]) << shift) + np.arange(size)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    # Column ``columns`` of the symbols stands behind all ends; column 0 of ``before`` has nothing before it.
    after = np.tile(np.arange(1, columns + 2), (rows, 1))
    before = np.tile(np.arange(-1, columns), (rows, 1))
    open_ = np.arange(rows)
    while True:
        root = tree[open_, 1]
        going = root < none
        if not going.any():
            return ids[:, :columns]
        open_, root = open_[going], root[going]
        place, made = root & (size - 1), table.made[root >> shift]
        gone = after[open_, place]
        follower = after[open_, gone]
        leader = before[open_, place]
        ids[open_, place], ids[open_, gone] = made, -1
        after[open_, place] = follower
        before[open_, np.minimum(follower, columns)] = place
        leading = np.where(leader >= 0, ids[open_, leader], -1)
        # Three leaves change: the one that is gone, the merged symbol's own and its leader's. Without a leader the
        # own one is written again, and so where the last symbol, which has no leaf, is gone.
        own = (table.of(made, ids[open_, np.minimum(follower, columns)]) << shift) + place
        nodes = np.stack([np.where(gone < size, gone, place), np.where(leader >= 0, leader, place), place]) + size
        tree[open_, nodes[0]] = none
        tree[open_, nodes[1]] = (table.of(leading, made) << shift) + leader
        tree[open_, nodes[2]] = own
        for _ in range(shift):
            nodes >>= 1
            tree[open_, nodes] = np.minimum(tree[open_, 2 * nodes], tree[open_, 2 * nodes + 1])


def _coded(strings: list[str]) -> tuple[list[str], np.ndarray]:
    """The different ones among the strings, and for each string its place among them."""
    places = dict(zip(distinct := dict.fromkeys(strings), range(len(distinct)), strict=True))
    return list(places), np.fromiter(map(places.__getitem__, strings), np.int64, len(strings))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def _gathered(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[c]:starts[c + 1]]`` one behind the other, and where each begins."""
    begins, lengths = starts[codes], starts[codes + 1] - starts[codes]
    at = _starts(lengths)
    return flat[np.repeat(begins - at[:-1], lengths) + np.arange(at[-1])], at


def _specification(path: str) -> dict:
    """The vocabulary file, if it is a plain byte-level BPE as the tokenizers library writes it."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, cutter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if (
        model["type"] != "BPE" or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space")
        or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        or not cutter.get("use_regex", True) or not plain or any(re.search(f"[{SPACES}]", t["content"]) for t in added)
    ):
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    return spec


class TokenBytes:
    """The bytes of each token, for decoding."""

    def __init__(self, path: str):
        spec, letters = _specification(path), byte_letters()
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec.get("added_tokens") or []}
        self.bytes_of = [b""] * (max(names) + 1)
        for i, name in names.items():
            known = all(c in letters for c in name)
            self.bytes_of[i] = bytes(letters[c] for c in name) if known else name.encode()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.starts = _starts(np.array(list(map(len, self.bytes_of)), np.int64))

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; as in the library, ids beyond the vocabulary give nothing and broken UTF-8 gives U+FFFD."""
        table, n = self.bytes_of, len(self.bytes_of)
        return b"".join([table[i] for i in ids if i is not None and 0 <= i < n]).decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of rows of ids that lie one behind the other, all of them in the vocabulary."""
        found, at = _gathered(self.flat, self.starts, ids)
        found, ends = found.tobytes(), at[_starts(lengths)].tolist()
        return [found[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


class BytePairs:
    """A vocabulary's merges and added tokens, for encoding."""

    def __init__(self, path: str):
        spec, letters = _specification(path), byte_letters()
        names, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        ranks = {(names[a], names[b]): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.table = PairTable(ranks, [names[a + b] for a, b in pairs])
        self.of_byte = np.array([names[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.kind = np.dtype("<u2" if max([*names.values(), *self.special.values()]) < 1 << 16 else "<u4")
        # Pieces met of late, and those met before them.
        self.made_special = {name: np.array([i], self.kind).tobytes() for name, i in self.special.items()}
        self.known, self.older = dict(self.made_special), {}
        # No piece goes on from a character to white space behind it, so a text can be cut into units there.
        self.unit = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
        self.piece = regex.compile(_piece(r"\p{L}", r"\p{N}"))
        self.ascii_piece = re.compile(_piece("a-zA-Z", "0-9"))

    def _merge_pieces(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        """Pieces with their ids, each merged on its own: short ones of a size together, long ones one by one."""
        raw = [piece.encode() for piece in pieces]
        lengths = np.array(list(map(len, raw)), np.int64)
        for k in np.flatnonzero(lengths > LONG_PIECE).tolist():
            ids = merged(self.of_byte[np.frombuffer(raw[k], np.uint8)].tolist(), self.table.ranks, self.table.results)
            yield pieces[k], np.array(ids, self.kind).tobytes()
        # The least tree that a piece of n bytes, with n - 1 pairs, fits into.
        sizes = np.array([1 << max(0, n - 2).bit_length() for n in range(LONG_PIECE + 1)])[np.minimum(lengths, LONG_PIECE)]
        for size in np.unique(sizes).tolist():
            chosen = np.flatnonzero((lengths <= LONG_PIECE) & (sizes == size))
            for begin in range(0, len(chosen), ROWS):
                some = chosen[begin : begin + ROWS]
                padded = np.frombuffer(b"".join([raw[k].ljust(size + 1, b"\0") for k in some.tolist()]), np.uint8).reshape(-1, size + 1)
                ids = np.where(np.arange(size + 1) < lengths[some, None], self.of_byte[padded], -1)
                ids = merged_rows(ids, self.table)
                ends = np.cumsum((ids >= 0).sum(1)) * self.kind.itemsize
                flat = ids[ids >= 0].astype(self.kind).tobytes()
                at = 0
                for k, end in zip(some.tolist(), ends.tolist(), strict=True):
                    yield pieces[k], flat[at:end]
                    at = end

    def _pieces_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces; those met of late are looked up."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, dict(self.made_special)
        known, older = self.known.get, self.older.get
        found = [known(p) or older(p) for p in pieces]
        new = dict(self._merge_pieces([p for p, ids in zip(pieces, found, strict=True) if ids is None]))
        self.known.update((p, ids) for p, ids in zip(pieces, found, strict=True) if ids)
        self.known.update((p, ids) for p, ids in new.items() if len(p) <= REMEMBERED_CHARS)
        return [ids or new[p] for p, ids in zip(pieces, found, strict=True)]

    def _cut(self, units: list[str], special: bool) -> list[list[str]]:
        """The pieces of each unit; special tokens, if there are any, are pieces of their own."""
        ascii_piece, piece = self.ascii_piece.findall, self.piece.findall
        if not special:
            return [ascii_piece(unit) if unit.isascii() else piece(unit) for unit in units]
        parts = [self.cut_special.split(unit) for unit in units]
        return [[p for k, part in enumerate(some) for p in ([part] if k % 2 else piece(part))] for some in parts]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and where each text's begin and the last one's end.

        Each unit and each piece is looked at once, however often it stands in the texts.
        """
        units = [self.unit.findall(text) for text in texts]
        distinct, unit_codes = _coded([u for found in units for u in found])
        pieces = self._cut(distinct, bool(self.special) and any(map(self.cut_special.search, texts)))
        distinct, piece_codes = _coded([p for found in pieces for p in found])
        ids = self._pieces_ids(distinct)
        flat = np.frombuffer(b"".join(ids), self.kind).astype(np.int32)
        ends = _starts(np.array(list(map(len, ids)), np.int64) // self.kind.itemsize)
        flat, ends = _gathered(flat, ends, piece_codes)
        ends = ends[_starts(np.array(list(map(len, pieces)), np.int64))]
        flat, ends = _gathered(flat, ends, unit_codes)
        return flat, ends[_starts(np.array(list(map(len, units)), np.int64))]


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    """One per worker and file; keeps the pieces it has met from batch to batch."""
    return BytePairs(path)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


def _slices(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of rows of some TOGETHER bytes each, a row at least; ``ends`` are the running sums of the rows' bytes."""
    begin = 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _running(column: pa.Array, width: int) -> np.ndarray:
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    return np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64) * width)


def _encode(batches: Iterator[pa.RecordBatch], path: str, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    model = byte_pairs(path)
    for batch in batches:
        for part in _slices(batch, _running(batch.column(text), 1)):
            values, ends = model.encode([t or "" for t in part.column(text).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
            kept = [n for n in part.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), lists], names=[*kept, ids])


def _decode(batches: Iterator[pa.RecordBatch], path: str, ids: str, text: str) -> Iterator[pa.RecordBatch]:
    model = token_bytes(path)
    for batch in batches:
        # An id becomes some four bytes, each of which is found by a number.
        for part in _slices(batch, _running(batch.column(ids), 16)):
            # Without nulls and ids beyond the vocabulary, as encoding gives them, nothing has to be left out.
            flat = part.column(ids).flatten()
            span = pc.min_max(flat)
            plain = not flat.null_count and (span["min"].as_py() or 0) >= 0
            if plain and (span["max"].as_py() or 0) < len(model.bytes_of):
                lengths = pc.fill_null(pc.list_value_length(part.column(ids)), 0).to_numpy()
                texts = model.decode_all(flat.to_numpy(), lengths)
            else:
                texts = [model.decode(row or []) for row in part.column(ids).to_pylist()]
            kept = [n for n in part.schema.names if n != ids]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(texts, pa.string())], names=[*kept, text])


def _mapped(df: DataFrame, column: str, made: str, kind, fn) -> DataFrame:
    """The table with ``column`` replaced, at the end, by ``made``, which ``fn`` computes from batches of rows."""
    if any(n.lower() == made.lower() for n in df.columns if n != column):
        raise ValueError(f"the table already has a column {made}; name another one")
    ship_code(df.sparkSession)
    schema = df.drop(column).schema.add(made, kind)
    return df.mapInArrow(fn, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The rows with ``text_col`` replaced by ``ids_col``, its token ids as the tokenizers library gives them.

    Without begin, end or other added tokens; a special token's string inside a text becomes its id, which is the
    library's default. ``path`` names a vocabulary file of the library's format for byte-level BPE, present on every
    executor; another kind of tokenizer is an error. Whole texts are encoded by ``merged``; a worker
    remembers pieces it has met, in bounded memory. Rows stay where they are: nothing is
    shuffled. Null text counts as empty (no ids); repeated rows are encoded each; other columns are kept, whatever their
    names, but one named ``ids_col`` is an error; an empty table gives an empty table.
    """
    return _mapped(df, text_col, ids_col, ArrayType(IntegerType()), lambda rows: _encode(rows, path, text_col, ids_col))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with ``ids_col`` (array of integers) replaced by ``text_col``, special tokens written out.

    Null ids count as none (empty text); null ids within an array and those beyond the vocabulary give nothing; bytes that are
    no UTF-8 give U+FFFD. Other columns are kept; one named ``text_col`` is an error; an empty table gives an empty table.
    """
    small = df.withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    return _mapped(small, ids_col, text_col, StringType(), lambda rows: _decode(rows, path, ids_col, text_col))
