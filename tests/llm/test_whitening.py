"""Whitening against numpy on the whole list of vectors."""

import math

import numpy as np
import pytest


def brute(rows, components=4):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in good]
    width = max(set(sizes), key=lambda w: (sizes.count(w), w), default=0)
    good = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in good if len(v) == width]
    fit = sorted({x for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    f = np.array(fit, float)
    centre = f - f.mean(axis=0)
    e, v = np.linalg.eigh(centre.T @ centre / n)
    return good, n, s, f.mean(axis=0), e[::-1], v[:, ::-1]


def check(spark, rows, parts=3, **kw):
    from specflow.llm.op13_whitening import whitened

    frame = spark.createDataFrame([(i, v, "z", 1.5) for i, v in rows], "vec_id long, embedding array<float>, x string, whitened double").repartition(parts)
    got = whitened(frame, **kw).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]  # as floats
    good, n, s, mean, e, v = brute(rows)
    shown = min(4, len(s))
    assert len(got) == len(good) * shown and {r["n"] for r in got} == {n}
    dev = sorted(((i, sum((n * a - b) ** 2 for a, b in zip(x, s))) for i, x in good), key=repr)
    for k in range(shown):
        mine = [r for r in got if r["component"] == k + 1]
        assert sorted(((r["vec_id"], r["deviation"]) for r in mine), key=repr) == dev
        want = [((np.array(x) - mean) @ v[:, k] / np.sqrt(e[k]), i) for i, x in good]
        by = {}
        for w, i in want:
            by.setdefault(i, []).append(w)
        have = {}
        for r in mine:
            have.setdefault(r["vec_id"], []).append(r["whitened"])
        signs = [max(np.abs(np.sort(np.array(have[i]) * g) - np.sort(by[i])).max() for i in by) for g in (1, -1)]
        assert min(signs) < 1e-8, (k, signs)
        assert all(abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9 for r in mine)
    assert max(r["identity_error"] for r in got) < 1e-9
    return got


def vectors(seed, n, width):
    g = np.random.default_rng(seed)
    mix = g.normal(size=(width, width)) * np.linspace(2, 0.2, width)
    return [(i, (g.normal(size=width) @ mix + 3).tolist()) for i in range(n)]


def test_awkward_rows(spark):
    rows = vectors(1, 400, 6)
    rows += [(5, rows[0][1])] * 150 + [(None, rows[1][1]), (None, None), (900, None), (901, [None] * 6), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] * 6),
                                        (904, [1.0, 2.0]), (905, []), (906, [-0.0] * 6), (907, [-0.001] * 6)]
    check(spark, rows)


def test_blocks_and_small_widths(spark, monkeypatch):
    import specflow.llm.op13_whitening as op

    monkeypatch.setattr(op, "BLOCK_BYTES", 8 * 3 * 7)  # seven rows a block
    check(spark, vectors(2, 333, 3), parts=5)
    check(spark, vectors(3, 50, 2), parts=2)


def test_no_spread(spark):
    from specflow.llm.op13_whitening import whitened

    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitened(spark.createDataFrame([(1, None), (2, [])], schema)).count() == 0
    one = whitened(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0])] * 3, schema)).collect()
    assert len(one) == 12 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and (r["n"], r["deviation"]) == (1, 0) for r in one)
    flat = whitened(spark.createDataFrame([(i, [float(i), 0.0, 0.0]) for i in range(9)], schema)).collect()  # one direction only
    assert len(flat) == 27 and all((r["whitened"] is None) == (r["component"] > 1) for r in flat) and flat[0]["identity_error"] < 1e-12


@pytest.mark.parametrize("size", [10, 1 << 19, 1 << 40])
def test_exact_deviations(size):
    from specflow.llm.op13_whitening import deviations

    g = np.random.default_rng(size)
    x = g.integers(-size, size, (50, 9))
    for n, big in ((7, 1 << 20), (10**6, 1 << 55), (10**11, 1 << 62)):
        s = [int(v) for v in g.integers(-big, big, 9)]
        want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s)) for row in x]
        assert deviations(x, n, s) == [v if v < 1 << 63 else None for v in want]
