"""p-values and intervals against tables, enumeration and plain resampling."""

import itertools
import math
import random

import numpy as np
import pytest

from marlowe.operators import inference


def ranks(values):
    order = sorted(values)
    return [sum(o < v for o in order) + (sum(o == v for o in order) + 1) / 2 for v in values]


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_exact_p_is_a_count_of_signs(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        least = min(sum(s <= w for s in sums), sum(s >= w for s in sums))
        assert inference.signed_rank_p(w, n, 0, 0.0) == pytest.approx(min(1, 2 * least / 2**n), abs=1e-12)


def test_tabled_values():
    """Critical values of the signed-rank table, two-sided: the largest sum at or below 0.05."""
    for n, w in {6: 0, 7: 2, 8: 3, 9: 5, 10: 8, 15: 25, 20: 52, 25: 89, 30: 137, 50: 434}.items():
        assert inference.signed_rank_p(w, n, 0, 0.0) <= 0.05 < inference.signed_rank_p(w + 1, n, 0, 0.0)
    assert inference.signed_rank_p(8, 10, 0, 0.0) == pytest.approx(0.048828125, abs=1e-12)
    assert inference.signed_rank_p(0.0, 0, 5, 0.0) == 1.0
    mean, sd = 60 * 61 / 4, math.sqrt(60 * 61 * 121 / 24)
    assert inference.signed_rank_p(mean + 1.959963985 * sd, 60, 0, 0.0) == pytest.approx(0.05, abs=1e-6)


def test_pairs_with_ties_zeros_and_flat_differences(spark):
    rng = random.Random(4)
    a, b = {i: rng.randrange(6) for i in range(40)}, {i: rng.randrange(8) for i in range(40)}
    rows = [("a", i, float(v)) for i, v in a.items()] + [("b", i, float(v)) for i, v in b.items()] + [("c", i, v + 1.0) for i, v in a.items()] + [("d", i, float(v)) for i, v in a.items()] + [("e", 1, 1.0), ("e", 2, None)]
    got = {(r.a, r.b): r for r in inference.paired_significance(spark.createDataFrame(rows, "s STRING, u INT, v DOUBLE"), "s", "u", "v").collect()}
    d = [b[i] - a[i] for i in range(40) if b[i] != a[i]]
    size = [abs(x) for x in d]
    r = ranks(size)
    tied = sum(size.count(s) ** 3 - size.count(s) for s in set(size))
    w = sum(x for x, s in zip(r, d, strict=True) if s > 0)
    ab = got["a", "b"]
    assert (ab.n, ab.w_plus) == (40, w) and ab.w_minus == len(d) * (len(d) + 1) / 2 - w
    m = len(d)
    z = abs(w - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - tied / 48)
    assert ab.wilcoxon_p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-9)
    full = np.array([b[i] - a[i] for i in range(40)])
    assert ab.std_diff == pytest.approx(full.std()) and ab.cohens_d == pytest.approx(full.mean() / full.std())
    ac, ad = got["a", "c"], got["a", "d"]
    assert (ac.t_p, ac.cohens_d, ac.significant) == (0.0, 0.0, True) and (ad.t_p, ad.wilcoxon_p, ad.significant) == (1.0, 1.0, False)
    assert not any("e" in pair for pair in got)


def test_interval_is_as_wide_as_plain_resampling(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 60)
    y = x + rng.integers(-6, 7, 60)
    rows = [("g", i, int(p), int(q)) for i, (p, q) in enumerate(zip(x, y, strict=True))] + [("flat", i, 3, i) for i in range(5)]
    got = {r.g: r for r in inference.bootstrap_correlation(spark.createDataFrame(rows, "g STRING, u INT, x INT, y INT"), "g", "u", "x", "y", 1000).collect()}
    rho = lambda i: np.corrcoef(ranks(x[i].tolist()), ranks(y[i].tolist()))[0, 1]
    plain = [rho(rng.integers(0, 60, 60)) for _ in range(1000)]
    low, high = np.percentile(plain, [2.5, 97.5])
    assert got["g"].rho == pytest.approx(rho(np.arange(60)))
    assert got["g"].high - got["g"].low == pytest.approx(high - low, rel=0.2) and got["g"].low == pytest.approx(low, abs=0.05)
    assert (got["flat"].rho, got["flat"].low) == (None, None)
