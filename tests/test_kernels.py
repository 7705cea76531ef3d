"""Planted truths and properties of the numpy kernels."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vectide.kernels import changes, patterns, statistics


def test_change_points_planted():
    assert changes.segments(np.ones((200, 3))) == []
    one = np.vstack([np.zeros((100, 2)), np.full((100, 2), 10.0)])
    assert changes.segments(one) == [100] and changes.severity(one, 100)[0] > 0.99
    three = np.vstack([np.full((50, 1), x) for x in (0.0, 8.0, -3.0, 5.0)])
    assert changes.segments(three) == [50, 100, 150]
    assert changes.segments(np.zeros((3, 2))) == []


def test_online_detector():
    d = changes.Online()
    flat = [d.observe(np.zeros(3)) for _ in range(500)]
    assert not any(flat)
    assert d.observe(np.full(3, 50.0)) is not None


def test_motif_and_discord_planted():
    base = np.array([[0.01 * i + d for d in range(4)] for i in range(100)])
    for at in (10, 40, 70):
        for k in range(5):
            base[at + k] = [10 + 0.5 * k + 0.1 * d for d in range(4)]
    m = patterns.motifs(base, 5, 3)[0]
    assert [o for o, _ in m["occurrences"]] == [10, 40, 70] and m["period"] == 30
    wave = np.sin(np.arange(120) * 2 * np.pi / 10)[:, None]
    wave[60:64] += 5
    assert 50 <= patterns.discords(wave, 8, 1)[0][0] <= 64
    assert patterns.motifs(base[:6], 5) == []


def brute_profile(x, w, zone):
    n = len(x) - w + 1
    return [min((patterns.window_distance(x, i, j, w) for j in range(n) if abs(i - j) >= zone), default=math.inf) for i in range(n)]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 5))
def test_matrix_profile_brute(seed, w):
    x = np.random.default_rng(seed).standard_normal((25, 2))
    assert np.allclose(patterns.matrix_profile(x, w)[0], brute_profile(x, w, max(1, math.ceil(w / 2))))


def test_signature_incremental_and_levels():
    x = np.random.default_rng(1).standard_normal((12, 3))
    s = np.zeros(12)
    for a, b in zip(x, x[1:]):
        s = patterns.extend_signature(s, a, b)
    assert np.allclose(s, patterns.signature(x, 2))
    assert len(patterns.signature(x, 3)) == 3 + 9 + 27 and len(patterns.log_signature(x, 2)) == 3 + 3
    assert np.allclose(patterns.signature(x, 2)[:3], x[-1] - x[0])


def test_frechet():
    a, b = np.array([[0.0, 0], [1, 0], [2, 0]]), np.array([[0.0, 1], [1, 1], [2, 1]])
    assert patterns.frechet(a, b) == 1.0 and patterns.frechet(a, a) == 0.0 and patterns.frechet(a, a[:0]) == math.inf


def test_topology_two_groups():
    x = np.vstack([np.random.default_rng(0).normal(0, 0.01, (10, 2)), np.random.default_rng(1).normal(9, 0.01, (10, 2))])
    f = patterns.topology(x, 10, threshold=1.0)
    assert f["n_components"] == 2 and f["max_persistence"] > 10 and f["betti"][-1] == 2
    assert patterns.topology(x[:1])["n_components"] == 1


def test_granger_directions():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((200, 2))
    b = np.vstack([np.zeros((1, 2)), a[:-1]]) + 0.1 * rng.standard_normal((200, 2))
    assert statistics.causality(a, b)["direction"] == "a_to_b"
    assert statistics.causality(b, a)["direction"] == "b_to_a"
    assert statistics.causality(a[:4], b[:4]) == {"direction": "none", "lag": 1, "f": 0.0, "p": 1.0, "effect": 0.0}


def test_statistics_numbers():
    assert abs(statistics.f_tail(4.9646, 1, 10) - 0.05) < 1e-4
    assert abs(statistics.beta_inc(2, 3, 0.5) - 0.6875) < 1e-12
    assert 0.4 < statistics.hurst(np.cumsum(np.random.default_rng(1).standard_normal((2000, 1)), 0)) < 0.7
    assert abs(statistics.rk45(lambda t, y: -y, 0, np.array([1.0]), 1.0)[0][0] - math.exp(-1)) < 1e-6
    assert statistics.sliced_wasserstein(np.array([0.5, 0.5]), np.array([0.5, 0.5]), np.eye(2)) == 0
    x = np.column_stack([np.arange(50.0), 0.1 * np.arange(50) % 3, np.zeros(50)])
    assert np.allclose(np.abs(statistics.principal_plane(x)[:, 0]).max(), np.abs(x[:, 0] - x[:, 0].mean()).max(), atol=0.2)
