import random
import re

import pytest

from tessera.llm import minhash_dedup as M
from tessera.llm.components import components

from .common import docs, rows, words

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(data, width):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, (d, _) in enumerate(data):
        ids = [x for k, (x, _) in enumerate(data) if find(k) == find(i) and x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def chain(seed=2):
    """Rows among which links form chains: each copy changes a few words of the one before."""
    rng = random.Random(seed)
    data, i = [], 100
    for _ in range(6):
        w = words(rng, 120, 400).split()
        for _ in range(7):
            data.append((i, " ".join(w)))
            i += 1
            w = list(w)
            for _ in range(rng.choice([1, 4, 6, 9])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return data


@pytest.mark.parametrize("width", [2, 5])
def test_equals_brute_force(spark, width, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_KEYS", 5000)
    data = rows(8, 40) + chain()
    out = M.near_duplicates(docs(spark, data).repartition(3), width).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out], key=str) == brute(data, width)


def test_one_of_each_group_stays(spark):
    data = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, None), (4, ""), (5, "x"), (6, "x"), (None, "x y"), (None, "y x")]
    kept = M.keep_one(docs(spark, data)).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted([data[0], data[2], data[3], data[4], data[6], data[7]], key=str)
    assert kept[0].part == "p"
    assert M.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("most", [100_000, 7])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr("tessera.llm.components.TASK_EDGES", most)
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, k) for k in range(201, 240)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(30)).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
