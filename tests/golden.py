"""The seven-line corpus whose results were worked out by hand, and brute-force models."""

from __future__ import annotations

import math
from itertools import combinations

CORPUS = [
    "the cat eats fish",
    "the dog eats meat",
    "the cat drinks milk",
    "the dog drinks water",
    "the cat sleeps",
    "the dog barks",
    "a cat eats",
]

PAIR_COUNTS = {
    ("cat", "drinks"): 1, ("cat", "eats"): 2, ("cat", "sleeps"): 1, ("dog", "barks"): 1,
    ("dog", "drinks"): 1, ("dog", "eats"): 1, ("drinks", "milk"): 1, ("drinks", "water"): 1,
    ("eats", "fish"): 1, ("eats", "meat"): 1, ("the", "cat"): 3, ("the", "dog"): 3,
}


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "line string")


def relative_entropy(p: float, q: float) -> float:
    return p * math.log(p / (0.99 * q + 0.01 * p)) if p else 0.0


def measures(a: dict, b: dict, integer: bool = True) -> dict:
    """All measures of two vectors, straight from the union of their contexts."""
    half = (lambda x: x // 2) if integer else (lambda x: x / 2)
    out = dict(dot=0, shared=0, l1=0, l2=0, jsd=0.0, askew1=0.0, askew2=0.0)
    for c in a.keys() | b.keys():
        v1, v2 = a.get(c, 0), b.get(c, 0)
        out["l1"] += abs(v1 - v2)
        out["l2"] += (v1 - v2) ** 2
        if c in a:
            out["askew1"] += relative_entropy(v1, v2)
        if c in b:
            out["askew2"] += relative_entropy(v2, v1)
        if c in a and c in b:
            out["dot"] += v1 * v2
            out["shared"] += v1 + v2
            out["jsd"] += relative_entropy(v1, half(v1 + v2)) + relative_entropy(v2, half(v1 + v2))
        elif c in a:
            out["jsd"] += relative_entropy(v1, half(v1))
        else:
            out["jsd"] += relative_entropy(v2, v2 / 2)
    total = sum(a.values()) + sum(b.values())
    norm = math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values()))
    return {
        "cosine": out["dot"] / norm,
        "lin": out["shared"] / total,
        "wjaccard": out["shared"] / 2 / (total - out["shared"] / 2),
        "l1": out["l1"],
        "l2": math.sqrt(out["l2"]),
        "jsd": out["jsd"],
        "askew1": out["askew1"],
        "askew2": out["askew2"],
    }


def all_measures(rows: list[tuple[str, str, int]], integer: bool = True) -> dict:
    vectors: dict[str, dict[str, int]] = {}
    for target, context, n in rows:
        vectors.setdefault(target, {})[context] = n
    return {
        (a, b): measures(vectors[a], vectors[b], integer)
        for a, b in combinations(sorted(vectors), 2)
    }
