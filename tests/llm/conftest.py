import random

import pytest

SYL = "th er on an re he in ed nd ha at en es of or nt ea ti to it is".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_texts():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, odd characters."""
    rng = random.Random(1)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(25)]
    near = [t.replace(" ", "\n", 1) + " x" for t in base[:6]] + [" ".join(w if rng.random() > 0.03 else "zz" for w in t.split()) for t in base[:10]]
    odd = [None, "", " \t\n", "é", "ÀÉ ßñ     x", "a" * 700, "ab " * 300, "\U0001f600 " * 90, "line one\nline one\n\nline one\nz"]
    passage = prose(rng, 60)
    hosts = [prose(rng, 20) + " " + passage + " " + prose(rng, 20) for _ in range(5)] + [passage + "\n" + passage]
    long = [prose(rng, 9000)]
    return base + base[:3] + near + odd + hosts + long + base[24:25] * 3
