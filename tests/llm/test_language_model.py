"""The language model's gradient step: against plain sums, and in less time than sums of sorted segments take."""

import time

import numpy as np
import pytest

from docgauge.llm import language_model as lm


def batch(seed: int, n: int, width: int, features: int, first: int):
    """Rows as _rows makes them, some of them in a large share of all tokens, and slopes."""
    dice = np.random.default_rng(seed)
    rows = np.minimum(dice.zipf(1.3, (n, features)), lm.CLASS_ROWS - lm.CLASSES - 1) + lm.CLASSES
    rows[:, 0] = dice.integers(0, first, n)
    return rows, dice.normal(size=(n, width)).astype(np.float32)


def segments(table, seen, rows, slope):
    """One AdaGrad step by sums of sorted segments."""
    flat = rows.T.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    g = np.add.reduceat(np.ascontiguousarray(slope.T).take(order % len(rows), axis=1), cut, axis=1).T
    at = flat[cut].astype(np.int64)
    squares = seen.take(at, axis=0)
    squares += g * g
    seen[at] = squares
    table[at] -= lm.RATE * g / np.sqrt(squares)


@pytest.mark.parametrize("n, width, features, first", [(1, 3, 2, 1), (2, 4, 4, 32), (40, 5, 5, 1), (3000, 8, 4, 32), (8192, 32, 5, 1)])
def test_step_sums_the_slopes_of_equal_rows(n, width, features, first):
    rows, slope = batch(n, n, width, features, first)
    table, seen = np.zeros((lm.CLASS_ROWS, width), np.float32), np.ones((lm.CLASS_ROWS, width), np.float32)
    lm._descend(table, seen, rows, slope)
    total = np.zeros((lm.CLASS_ROWS, width))
    for k in range(features):
        np.add.at(total, rows[:, k], slope)
    assert np.allclose(seen, 1 + total**2, rtol=1e-3, atol=1e-3)
    assert np.allclose(table, -lm.RATE * total / np.sqrt(1 + total**2), atol=1e-4)


def test_step_takes_less_than_sums_of_segments():
    rows, slope = batch(7, lm.BATCH, lm.MEMBERS, 4, lm.CLASSES)
    weights = [np.zeros((lm.CLASS_ROWS, lm.MEMBERS), np.float32), np.ones((lm.CLASS_ROWS, lm.MEMBERS), np.float32)]

    def seconds(step) -> float:
        took = []
        for _ in range(15):
            began = time.thread_time()
            step(*weights, rows, slope)
            took.append(time.thread_time() - began)
        return min(took)

    assert seconds(lm._descend) < 0.75 * seconds(segments)
