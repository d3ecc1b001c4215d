import hashlib
import math

import numpy as np
import pytest

from trawl.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def brute(rows):
    """Codebooks and codes by trying every entry, in Python's whole numbers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // 16
    parts = [[r[1][p * w : p * w + w] for r in kept] for p in range(16)]
    books = [[list(x) for x in own[:64]] for own in parts]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book)) for x in own] for own, book in zip(parts, books)]

    for _ in range(2):
        found = assign()
        for p, book in enumerate(books):
            for k in range(len(book)):
                mine = [x for x, (_, c) in zip(parts[p], found[p]) if c == k]
                if mine:
                    book[k] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    errors = [sum(found[p][r][0] for p in range(16)) for r in range(len(kept))]
    sums = {}
    for (_, _, label), e in zip(kept, errors):
        sums[label] = sums.get(label, 0) + e
    return sorted([(kept[r][0], "".join(f"{found[p][r][1]:02x}" for p in range(16)), errors[r], sums[kept[r][2]], digest) for r in range(len(kept))], key=repr)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = vector_codes.compress(frame)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.mark.parametrize("dims", [16, 64])
def test_equals_brute_force(spark, dims):
    rng = np.random.default_rng(1)
    vectors = rng.normal(0, 0.2, (300, dims))
    vectors[40:80] = vectors[:40] + rng.normal(0, 0.01, (40, dims))
    vectors[100:130] = vectors[7]  # a group of copies
    rows = [(int(i), [float(np.float32(x)) for x in v], None if i % 11 == 0 else int(i % 3)) for i, v in zip(rng.permutation(1000), vectors)]
    assert got(spark, rows) == brute(rows)


def test_unusable_vectors_nulls_and_repeats(spark):
    ok = [0.5] * 16
    rows = [(1, ok, 1), (1, ok, 1), (2, None, 1), (3, [None] + ok[1:], 2), (4, [float("nan")] + ok[1:], 2), (5, [float("-inf")] + ok[1:], 2), (None, [-0.001] * 16, None), (7, [2.0] * 16, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []
    assert got(spark, rows[2:4]) == []


def test_vectors_of_other_lengths_have_no_code(spark):
    rows = [(1, [0.25] * 32, 1), (2, [0.25] * 16, 1), (3, [], 2)]
    found = {r[0]: r for r in got(spark, rows)}
    assert found[1][1:3] == ("00" * 16, 0) and found[2][1:3] == (None, None) and found[3][1:4] == (None, None, None)
    assert [r[1] for r in got(spark, [(1, [0.5] * 17, 1)])] == [None]


def test_ties_go_to_the_lower_entry_and_bounds_are_included():
    entries = np.array([[3, 4], [-5, 0], [5, 0], [0, 5], [3, 4]])
    book = vector_codes.Codebook(entries)
    code, distance = book.nearest(np.array([[0, 0], [3, 4], [10, 0], [-1, 0]]))
    assert code.tolist() == [0, 0, 2, 1] and distance.tolist() == [25, 0, 25, 16]


def test_largest_components_stay_exact():
    most = vector_codes.limit(4)
    book = vector_codes.Codebook(np.array([[most] * 4, [-most] * 4]))
    code, distance = book.nearest(np.array([[-most] * 4, [most] * 4, [most - 1] * 4]))
    assert code.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 4]
    assert 4 * (2 * most) ** 2 * 64 < 2**63
