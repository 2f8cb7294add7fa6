"""Ids of whole batches of texts against the library."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from reportloom.llm.packing import _portions, project
from reportloom.llm.tokens import WordEncoder, tokenizer, words_of

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["\x0b", "\x1c", "\x85", "\xa0", "\xad", "\x7f", " ", "​", "　", "\x00", "<|endoftext|>", "<|", "İ", "é", "\xe9", "\xdf", "\xbd"]


def texts(seed: int, n: int) -> list[str]:
    """Random texts of letters, digits, signs, odd white space, special strings and other scripts."""
    rng = random.Random(seed)
    signs = ["a", "B", "the", "don't", "I'LL", "7", "x9", "!", "--", " ", "  ", "\n", "\t", "\r\n", "Ж", "東京", "한", "🙂", "Ünder", "µ", *ODD]
    return ["".join(rng.choices(signs, k=rng.randint(0, 40))) for _ in range(n)]


def wanted(some: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(PATH).encode_batch(some, add_special_tokens=False)]


def split(ids: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    return [part.tolist() for part in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


@pytest.mark.parametrize("seed", range(4))
def test_ids_of_a_batch(seed):
    model = WordEncoder(PATH)
    for k in range(3):
        some = texts(10 * seed + k, 300)
        assert split(*model.batch(pa.array(some, pa.string()))) == wanted(some)


def test_every_character_alone_and_between_letters():
    some = [f"{chr(c)} a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0x500) if not 0xD800 <= c < 0xE000]
    assert split(*WordEncoder(PATH).batch(pa.array(some))) == wanted(some)


def test_slices_nulls_and_empty_batches():
    model = WordEncoder(PATH)
    some = pa.array(["left out", None, "", "  ", "one two", "two", None])
    assert split(*model.batch(some.slice(1, 5))) == wanted(["", "", "  ", "one two", "two"])
    for empty in (some.slice(0, 0), pa.array([None, None], pa.string()), pa.array(["", ""])):
        ids, sizes = model.batch(empty)
        assert len(ids) == 0 and sizes.tolist() == [0] * len(empty)


def test_words_end_with_their_text():
    words, held = words_of(pa.array(["ab", "cd e", " f", "g "]))
    assert words.cast(pa.large_string()).to_pylist() == ["ab", "cd", "e", "f", "g"] and held.tolist() == [1, 2, 1, 1]


def test_what_a_worker_forgets_changes_no_id(monkeypatch):
    monkeypatch.setattr("reportloom.llm.tokens.REMEMBERED", 20)
    model = WordEncoder(PATH)
    for k in range(5):
        some = texts(100 + k, 50)
        assert split(*model.batch(pa.array(some))) == wanted(some)


def test_points_do_not_depend_on_neighbours():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 300, 60)
    ids = rng.integers(0, 49_000, sizes.sum()).astype("<u2")
    together = project(ids, sizes)
    alone = [project(part, np.array([len(part)]))[0] for part in np.split(ids, np.cumsum(sizes)[:-1])]
    assert (together == np.array(alone)).all()
    assert project(ids[:0], np.array([0, 0])).tolist() == [[0.0] * 3] * 2


def test_portions_cover_all_rows():
    some = pa.array(["x" * n for n in (5, 9 << 20, 0, 3 << 20, 2 << 20, 1, 0)])
    found = list(_portions(some))
    assert found == [(0, 1), (1, 1), (2, 2), (4, 3)]
    assert list(_portions(some.slice(0, 0))) == []
