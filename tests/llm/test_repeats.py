import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from evidara.llm import op1_suffix_arrays as op1
from evidara.llm import op2_suffix_trees as op2
from evidara.llm import repeats
from evidara.llm.common import rolling, split_words
from tests.conftest import SMALL
from tests.llm.helpers import awkward, covered, empty, sha, words

import pyarrow as pa


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x0c\r\x1c\x1d\x85  é😀", max_size=30)), max_size=6))
def test_words_are_the_contract_s(texts):
    got, offsets = split_words(pa.array(texts, pa.string()))
    got = got.to_pylist()
    assert [got[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [words(t) for t in texts]


def test_rolling_is_one_hash_a_sequence():
    codes = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    for width in range(1, 8):
        h = rolling(codes, width)
        assert len(h) == 8 - width
        same = {(i, j) for i in range(len(h)) for j in range(len(h)) if h[i] == h[j]}
        assert same == {(i, j) for i in range(len(h)) for j in range(len(h)) if codes[i : i + width].tolist() == codes[j : j + width].tolist()}


@pytest.fixture(params=[(4_000_000, 2_000_000), (3000, 100)])
def cut(request, monkeypatch):
    """One block and group, or very many of both."""
    monkeypatch.setattr(repeats, "BLOCK_CHARS", request.param[0])
    monkeypatch.setattr(repeats, "GROUP_KEYS", request.param[1])


def test_numbers_of_ranges_never_fall():
    rng = np.random.default_rng(3)
    for most in (1, 50, 10**6):
        sizes = rng.integers(0, 300, 40).tolist()
        found = repeats.Ranges(sizes, most)
        at, share = np.repeat(np.arange(40), 20), np.tile(np.linspace(0, 1, 20), 40)
        got = found.of(at, share)
        assert got[0] == 0 and (np.diff(got) >= 0).all() and (np.diff(got) <= 1).sum() >= len(got) - 1 - sum(n > 20 * most for n in sizes) * 20
        assert all(found.parts[r] == max(1, -(-n // most)) for r, n in enumerate(sizes))
    counts = np.zeros(1 << 16, np.int64)
    counts[[0, 1, 255, 256, 300, 65535]] = [5, 10**7, 3, 10, 20, 4]
    groups = repeats.Groups(counts)
    keys = np.sort(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    hot = (np.uint64(1) << np.uint64(48)) + np.arange(0, 2**48, 2**40, dtype=np.uint64)
    assert (np.diff(groups.of(keys)) >= 0).all() and len(np.unique(groups.of(hot))) == 5


def test_op2_equals_brute_force(spark, cut):
    df, rows = awkward(spark)
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed, sha(r.kept_text)) for r in op2.substring_dedup(df).collect())
    want = sorted((d or -1, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))) for d, w, gone in covered(rows, 13))
    assert got == want
    assert op2.substring_dedup(empty(spark)).count() == 0


def test_op1_equals_brute_force(spark, cut):
    df, rows = awkward(spark)
    got = {(r.doc_id, r.start, r.end, r.n_removable) for r in op1.repeated_spans(df).collect()}
    removable = {d: gone for d, w, gone in covered(rows, 50)}
    mirrored = covered([(None if d is None else -d, *rest) for d, *rest in rows], 50)
    want = set()
    for d, _, later in mirrored:
        if d is None:
            continue
        both = later | removable[-d]
        starts = sorted(i for i in both if i - 1 not in both)
        for s in starts:
            e = s
            while e in both:
                e += 1
            want.add((-d, s, e, sum(i in removable[-d] for i in range(s, e))))
    assert got == want and want
    assert op1.repeated_spans(empty(spark)).count() == 0


def test_queries_equal_sql(spark, duck, same_rows, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_CHARS", 60_000)
    monkeypatch.setattr(repeats, "GROUP_KEYS", 9_000)
    same_rows(op2.op2_substring_dedup(spark, SMALL).toPandas(), duck.sql(op2.SQL).df())
    same_rows(op1.op1_suffix_array_dedup(spark, SMALL).toPandas(), duck.sql(op1.SQL).df())
