import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spendkit.llm.storage import Bloom
from spendkit.llm.text import ALNUM, BLANK, grams, slices, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = [(ALNUM, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), (BLANK, re.compile(r"[^\x20\x09-\x0D]+"))]


@pytest.mark.parametrize("tables,pattern", PATTERNS)
@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words_against_patterns(tables, pattern, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("aBz09 _-@[`{\t\n\x0b\x1c\x7f\x00éÉß€😀 ") for _ in range(rng.randrange(40))) for _ in range(400)] + ["", None, "x" * 3000]
    hashes: dict[int, bytes] = {}
    for row, end, data, offsets in slices(pa.array(texts), most):
        found = words(data, offsets, tables)
        for k, text in enumerate(texts[row:end]):
            want = [w.encode() for w in pattern.findall((text or "").translate(LOW))]
            begin, stop = found.first[k], found.first[k + 1]
            assert found.texts(begin, stop) == want
            for code, word in zip(found.hashes[begin:stop].tolist(), want):
                assert hashes.setdefault(code, word) == word
    assert len(set(hashes.values())) == len(hashes)


def test_slices_cover_a_cut_of_an_array():
    column = pa.array(["a", None, "", "bcd", "é"]).slice(1, 3)
    got = [data[offsets[k] : offsets[k + 1]].tobytes() for _, _, data, offsets in slices(column, 1) for k in range(len(offsets) - 1)]
    assert got == [b"", b"", b"bcd"]
    assert list(slices(pa.array([], pa.string()))) == []


def test_grams_do_not_depend_on_their_place():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 4, 300).astype(np.uint64)
    for k in (1, 2, 5):
        got, seen = grams(codes, k), {}
        for at in range(len(codes) - k + 1):
            assert seen.setdefault(tuple(codes[at : at + k].tolist()), got[at]) == got[at]
        assert len(set(seen.values())) == len(seen)


def test_bloom_filter_loses_none_and_drops_most(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, 3000)
    bloom = Bloom.of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", 1 << 18)
    assert bloom.has(keys.view(np.uint64)).all()
    assert bloom.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01
    none = Bloom.of(spark.createDataFrame([], "k long"), "k", 1 << 18)
    assert not none.has(keys.view(np.uint64)).any()
