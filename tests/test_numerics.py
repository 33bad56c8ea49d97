"""Closed forms, recoverable fits, invariants."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from narrata.functions import numerics as N

T = np.linspace(0, 60, 61)


def test_peaks_on_plateaus_and_edges():
    assert N.peaks(np.array([0, 2, 2, 2, 0, 3, 1.0])).tolist() == [2, 5]
    assert N.peaks(np.array([3, 2, 1.0])).tolist() == []
    assert N.peaks(np.array([0, 1, 0, 5, 0.0]), 2).tolist() == [3]


def test_shape_facts():
    zero = N.shape_facts(np.zeros(5))
    assert zero["peak_volume"] == 0 and zero["wave_count"] == 0
    one = N.shape_facts(np.array([1, 2, 3.0]))
    assert one["wave_count"] == 1 and one["time_to_peak_days"] == 2
    assert N.shape_facts(np.array([0, 4, 0, 3, 0.0]))["wave_count"] == 2


def test_trend():
    assert N.mann_kendall(np.arange(28.0))["trend"] == "increasing"
    assert N.mann_kendall(-np.arange(28.0))["trend"] == "decreasing"
    assert N.mann_kendall(np.ones(28))["trend"] == "no trend"
    assert N.mann_kendall(np.arange(3.0))["p"] == 1.0
    assert N.mann_kendall(np.arange(10.0))["s"] == 45


@pytest.mark.parametrize("name,make", [("logistic", lambda: N.logistic(T, 20, 0.3, 25)), ("sir", lambda: N.sir(T, 12, 22, 0.5, 3.0)), ("bass", lambda: N.bass(T, 300, 0.01, 0.2, -2))])
def test_fits_recover_their_own_curves(name, make):
    y = make()
    params, ok, fitted = N.fit_lens(name, T, y)
    assert ok and params["r2"] > 0.98
    assert np.abs(fitted - y).max() < 0.15 * y.max()


def test_sir_peaks_where_it_says():
    y = N.sir(T, 9.0, 30.0, 0.4, 4.0)
    assert int(np.argmax(y)) == 30 and y.max() == pytest.approx(9.0, rel=1e-6)
    assert (np.diff(y[:30]) > 0).all() and (np.diff(y[31:]) < 0).all()


def test_stages():
    up, flat = np.linspace(1, 60, 60), np.ones(60) * 5
    assert N.classify(up, 0)["stage"] == "growth"
    assert N.classify(up[::-1], 0)["stage"] == "decay"
    assert N.classify(flat, 0)["stage"] == "stable"
    assert N.classify(flat, 113)["stage"] == "dormant" and N.classify(flat, 112)["stage"] == "stable"
    assert N.classify(np.concatenate([np.full(50, 40.0), np.ones(40)]), 0)["stage"] == "dormant"


def test_wave_slope():
    assert N.wave_slope(np.zeros(10)) is None
    assert N.wave_slope(np.concatenate([np.linspace(1, 50, 20), np.linspace(50, 1, 20)])) < 0
    assert N.wave_slope(np.linspace(1, 60, 60)) > 0


def test_f_tail():
    assert N.f_tail(1.0, 1, 1) == pytest.approx(0.5, abs=1e-9)
    assert N.f_tail(4.0, 1, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2), abs=1e-9)
    assert N.f_tail(0, 3, 9) == 1.0


def test_granger_finds_the_leader():
    rng = np.random.default_rng(0)
    x = rng.normal(size=120).cumsum()
    y = np.concatenate([[0], 0.8 * x[:-1]]) + 0.05 * rng.normal(size=120)
    assert N.granger(y, x)[0] < 1e-6 and N.granger(y, x)[1] <= 2
    assert N.granger(y[:6], x[:6]) is None


def test_windows():
    found = N.windows(100)
    assert (0, 99) in found and all(b - a >= 33 for a, b in found)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 100), min_size=4, max_size=40))
def test_reversing_a_series_turns_its_trend(values):
    a, b = N.mann_kendall(np.array(values)), N.mann_kendall(np.array(values[::-1]))
    assert a["s"] == -b["s"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=30))
def test_average_ranks_sum(values):
    assert N.average_ranks(np.array(values)).sum() == pytest.approx(len(values) * (len(values) + 1) / 2)
