"""Whitening against plain integer sums and numpy's eigenvectors."""

import math
import os

import numpy as np
import pytest

from casebook.llm import catalog, whitening

SMALL = "/root/testdata/sf0.001"


def brute(rows):
    """Of (vec_id, vector) rows: kept (vec_id, x), n, sums, eigenvalues and vectors, by whole numbers."""
    width = max((len(v) for _, v in rows if v is not None), default=0)
    kept = []
    for vec_id, v in rows:
        if v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        limited = [max(-(2.0**52), min(2.0**52, 64 * float(c))) for c in v]
        kept.append((vec_id, tuple([math.floor(c) + 1_000_000 for c in limited] + [1_000_000] * (width - len(v)))))
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit, strict=True)]
    centred = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    v = np.array([[sum(x[i] * x[j] for x in centred) / n**3 for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(v) if n else (np.zeros(0), np.zeros((0, 0)))
    return kept, fit, n, sums, values[::-1], vectors[:, ::-1], v


def check(got, rows):
    rows = [(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    kept, fit, n, sums, values, vectors, v = brute(rows)
    width = len(sums)
    real = int((values > max(values.max(initial=0.0), 0.0) * width * np.finfo(float).eps).sum())
    k = min(16, real)
    assert len(got) == len(kept) * k
    if not k:
        return
    deviation = {}
    for vec_id, x in kept:
        deviation.setdefault(vec_id, []).append(min(2**63 - 1, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))))
    by_row = {}
    for r in got:
        assert r["n"] == n and r["deviation"] in deviation[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-9)
        assert 0 <= r["identity_error"] < 1e-9
        by_row.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    want = {}
    for vec_id, x in kept:
        near = np.array([(n * c - s) / n for c, s in zip(x, sums, strict=True)])
        d = min(2**63 - 1, sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)))
        want.setdefault((vec_id, d), []).append(near @ vectors[:, :k] / np.sqrt(values[:k]))
    gaps = np.diff(values[: k + 1]) if len(values) > k else np.append(np.diff(values), -1.0)
    for c in range(k):
        if c and -gaps[c - 1] < 1e-9 * values[0] or -gaps[c] < 1e-9 * values[0]:
            continue  # a shared eigenvalue leaves its vectors free
        got_c = np.concatenate([sorted(by_row[key][c + 1], key=abs) for key in sorted(want, key=str)])
        want_c = np.concatenate([sorted((w[c] for w in want[key]), key=abs) for key in sorted(want, key=str)])
        sign = 1 if float(got_c @ want_c) >= 0 else -1
        assert np.allclose(got_c, sign * want_c, atol=1e-7 * max(1.0, np.abs(want_c).max()))


@pytest.mark.parametrize("name", ["small", "edge", "empty"])
def test_equals_brute_force(spark, name, edge_folder, empty_folder):
    if name == "small" and not os.path.isdir(SMALL):
        pytest.skip("test tables not present")
    folder = {"small": SMALL, "edge": edge_folder, "empty": empty_folder}[name]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(catalog.queries()["op12_whiten"](spark, folder).collect(), rows)


def whiten(spark, rows):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()


def test_wide_values_and_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(size=3) * [1, 30, 1e3]]) for i in range(70)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]
    check(whiten(spark, rows), rows)


def test_values_beyond_64_bits_end_there(spark):
    rows = [(i, [float(i) * 1e12, -float(i * i) * 1e11]) for i in range(40)] + [(400, [3e38, -3e38])]
    got = whiten(spark, rows)
    check(got, rows)
    assert {r["deviation"] for r in got if r["vec_id"] == 400} == {2**63 - 1}


def test_copies_weigh_nothing(spark):
    rows = [(i, [float(i % 7), float(i * i % 5)]) for i in range(30)]
    plain = {(r["component"], r["explained"]) for r in whiten(spark, rows)}
    assert {(r["component"], r["explained"]) for r in whiten(spark, rows + [(99, rows[3][1])] * 500)} == plain


def test_nothing_varies(spark):
    assert whiten(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert whiten(spark, [(1, []), (2, None)]) == []


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    y = rng.integers(0, [1, 2, 300, 2**40], size=(1000, 4))
    bits = [int(c).bit_length() for c in y.max(axis=0)]
    products = whitening.weighted(whitening.shared_bits(whitening.bit_planes(y, bits)), bits)
    whole = y.astype(object)
    for i, row in enumerate(products):
        assert row == [int((whole[:, i] * whole[:, j]).sum()) for j in range(i, 4)]
