"""Token ids and counts of whole texts, remembering the pieces of a text that are tokenised on their own."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa

#: Entries after which a worker forgets the pieces it has seen; bounds its memory, changes no result.
REMEMBERED = 800_000

#: Characters that one of the libraries takes as white space, besides the four plain ones.
PLAIN = " \n\t\r"
ODD = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000"

_W, _N, _X = f"[{PLAIN}{ODD}]", f"[^{PLAIN}{ODD}]", f"[{ODD}]"
#: A unit begins at the text's start or at plain white space right after a character that is no white space.
UNIT = re.compile(f"{_W}*{_N}+(?:{_X}{_W}*{_N}+)*(?:{_X}{_W}*)?|{_W}+")
_IS_PLAIN = np.isin(np.arange(256), [ord(c) for c in PLAIN])
#: The byte-level alphabet: bytes that print stand for themselves, all others, in their order, for the characters from 256 on.
_SELF = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in _SELF)}
#: What the word tokenizer cuts lower-cased Latin-1 words into.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class UnitCounter:
    """Token counts by a byte-level BPE whose pieces never hold white space after another character.

    Such a tokenizer always cuts where white space follows a character that is none, whatever
    stands around, and no special token holds white space; so a text's count is the sum over its units.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.known: dict[str, int] = {}

    def _learn(self, units: list[str]) -> None:
        if len(self.known) + len(units) > REMEMBERED:
            self.known.clear()
        found = self.model.encode_batch_fast(units, add_special_tokens=False)
        self.known.update(zip(units, map(len, found), strict=True))

    def unit_counts(self, units: list[str]) -> list[int]:
        counts = list(map(self.known.get, units))
        if None in counts:
            missing = list({u for u, c in zip(units, counts, strict=True) if c is None})
            self._learn(missing)
            counts = [self.known[u] if c is None else c for u, c in zip(units, counts, strict=True)]
        return counts

    def count(self, text: str) -> int:
        if any(run in text for run in _RUNS) or any(c in text for c in ODD):
            return sum(self.unit_counts(UNIT.findall(text)))
        # White space is single spaces and single line breaks: each of them begins a unit.
        units: list[str] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            units.append("\n" + first if units else first)
            units.extend([" " + word for word in rest])
        return sum(self.unit_counts(units))

    def starts(self, text: str) -> tuple[list[int], list[int]]:
        """Where the units of a text begin, and how many of its tokens stand before each; last, the ends of both."""
        units = UNIT.findall(text)
        return list(accumulate(map(len, units), initial=0)), list(accumulate(self.unit_counts(units), initial=0))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts between plain white space, each distinct one numbered once, and how many words each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, content = texts.buffers()
    offsets = np.frombuffer(offsets, "<i8", len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(content, np.uint8)[offsets[0] : offsets[-1]] if content else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    letter = ~_IS_PLAIN[raw]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    first[heads] |= letter[heads]
    begins = np.flatnonzero(first)
    # Without white space the words stand side by side; where each begins there, and the end of the last.
    packed = raw[letter]
    places = np.append(np.cumsum(letter)[begins] - 1, len(packed)).astype("<i8")
    words = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(packed)).dictionary_encode()
    return words, np.diff(np.searchsorted(begins, ends))


class WordEncoder:
    """Token ids by a tokenizer that drops white space and tokenises what stands between on its own.

    Such a word falls into pieces (runs of letters, single digits, runs of other signs) that are
    encoded one by one after lower-casing; words of Latin-1 characters are cut into their pieces here, so that words
    seen for the first time mostly consist of known pieces. All others go to the library whole.
    """

    def __init__(self, path: str):
        self.model = tokenizer(path)
        self.code = "H" if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.merged = self.model.model.tokenize

    def _merged(self, piece: str) -> bytes:
        """Ids of a piece, whose bytes go to the merges in the byte alphabet (printable ASCII is that already)."""
        plain = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_ALPHABET)
        return array(self.code, [token.id for token in self.merged(plain)]).tobytes()

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        new, whole, known = {}, [], self.pieces
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            # Special strings, signs that do not print (odd white space too) and characters beyond Latin-1 are the library's.
            if (not word.isascii() and max(word) > "\xff") or not word.isprintable() or "<|" in word:
                whole.append(word)
                continue
            parts = []
            for piece in _PIECE.findall(word.lower()):
                if (ids := known.get(piece)) is None:
                    ids = known[piece] = self._merged(piece)
                parts.append(ids)
            new[word] = parts[0] if len(parts) == 1 else b"".join(parts)
        if whole:
            encoded = self.model.encode_batch_fast(whole, add_special_tokens=False)
            new |= {w: array(self.code, e.ids).tobytes() for w, e in zip(whole, encoded, strict=True)}
        return new

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has.

        Each distinct word of the batch is looked up once; the ids of all words are gathered from those.
        """
        kind = np.dtype("<u2" if self.code == "H" else "<u4")
        words, held = words_of(texts)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        if missing := [w for w, got in zip(distinct, found, strict=True) if got is None]:
            new = self._learn(missing)
            found = [new[w] if got is None else got for w, got in zip(distinct, found, strict=True)]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            self.known |= new
        store = np.frombuffer(b"".join(found), kind)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        which = words.indices.to_numpy(zero_copy_only=False)
        counts = sizes[which]
        ends = np.cumsum(counts)
        # The k-th id of a word is the k-th after its begin in the store: its own place, shifted by the word.
        shift = (np.cumsum(sizes) - sizes)[which] - (ends - counts)
        ids = store[np.repeat(shift, counts) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.append(0, ends)[np.append(0, np.cumsum(held))])
