import random

import numpy as np

from vocaris.llm import suffix_array


def brute_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:].tolist())


def common(text, i, j, stop):
    n = 0
    while max(i, j) + n < len(text) and text[i + n] == text[j + n] != stop:
        n += 1
    return n


def texts():
    rnd = random.Random(5)
    for _ in range(300):
        k = rnd.choice([1, 2, 3, 200])
        yield np.array([rnd.randrange(k + 1) for _ in range(rnd.randrange(0, 80))], dtype=np.int64)
    unit = [rnd.randrange(1, 5) for _ in range(37)]
    yield np.array(unit * 12)
    yield np.array((unit + [0]) * 9 + unit[:20])
    yield np.zeros(64, dtype=np.int64)
    yield np.arange(50)
    yield np.arange(50)[::-1]


def test_order_equals_brute_force():
    for text in texts():
        assert suffix_array.suffix_array(text).tolist() == brute_order(text), text.tolist()


def test_permuted_prefixes_equal_brute_force():
    for text in texts():
        if len(text) < 2:
            continue
        order = suffix_array.suffix_array(text)
        for stop in (0, -5):
            plcp = suffix_array.permuted_lcp(text, order, stop)
            assert all(plcp[b] == common(text, a, b, stop) for a, b in zip(order[:-1], order[1:]))
