import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontaminate as D

from .common import docs, rows, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return WORD.findall((t or "").translate(UP))


def brute(data, items, width):
    wins = {}
    for i, t in items:
        w = split(t)
        n = min(width, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for i, t in data:
        w = split(t)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def item_table(spark, items):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, doc_id string, n string")


def case():
    import random

    data = rows(4, 50)
    rng = random.Random(9)
    items = [(100, data[5][1]), (7, data[8][1]), (8, None), (9, ""), (10, "w1 w2"), (11, words(rng, 12)), (11, data[5][1]), (12, "É ü 日本 A")]
    items += [(20 + k, words(rng, 25, 5)) for k in range(4)]
    return data, items


def test_equals_brute_force(spark, monkeypatch):
    data, items = case()
    for width, size, step in ((10, 1 << 20, 1 << 20), (3, 100, 50)):
        monkeypatch.setattr(D, "ITEM_BYTES", size)
        monkeypatch.setattr(D, "STEP", step)
        got = D.contamination(docs(spark, data).repartition(3), item_table(spark, items), width).collect()
        assert sorted(map(tuple, got), key=str) == brute(data, items, width)


@pytest.mark.parametrize("size", [1 << 20, 100])
def test_filter_keeps_clean_rows_whole(spark, monkeypatch, size):
    monkeypatch.setattr(D, "ITEM_BYTES", size)
    data, items = case()
    table = docs(spark, data)
    clean = [(i, t) for i, t in data if not any(b[-1] for b in brute([(i, t)], items, 10))]
    kept = D.drop_contaminated(table, item_table(spark, items)).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=str) == sorted(clean, key=str)
    assert kept[0].part == "p" and D.drop_contaminated(table, item_table(spark, [])).count() == len(data)
    assert D.contamination(docs(spark, []), item_table(spark, items)).collect() == []


def test_proximity():
    w = D.test_windows([(1, "red green blue")], 10)
    s = D.Segment.build(pa.array(["red x green blue", "red", "green blue red green y blue", "red x x x green blue"]), w.vocabulary)
    ((windows, _, _),) = w.groups
    assert s.phrases(windows, 3)[1].tolist() == []
    where = {int(np.searchsorted(s.first, p, "right") - 1) for p in s.proximities(windows, 3, 1)[1]}
    assert where == {0, 2}


def test_windows_are_distinct_and_know_their_items():
    w = D.test_windows([(1, "a b c d"), (2, "b c d"), (2, "b c"), (3, "d"), (4, None), (5, "a b c")], 3)
    named = {}
    for g, (windows, _, _) in enumerate(w.groups):
        for k, row in enumerate(windows):
            named[tuple(int(x) for x in w.vocabulary[row])] = w.items(g, k)
    word = {x: int(h) for x, h in zip("abcd", D.T.hash_words(pa.array(["a b c d"]), D.T.NOT_ALNUM, lower=True)[0], strict=True)}
    assert named == {tuple(word[x] for x in k): v for k, v in {"abc": ["1", "5"], "bcd": ["1", "2"], "bc": ["2"], "d": ["3"]}.items()}


def test_union_of_intervals():
    rng = np.random.default_rng(3)
    for _ in range(50):
        begin = rng.integers(0, 30, rng.integers(0, 8))
        end = begin + rng.integers(1, 9, len(begin))
        a, b = D.joined(begin, end)
        cover = set().union(*(range(i, j) for i, j in zip(begin, end, strict=True)), set())
        assert cover == set().union(*(range(i, j) for i, j in zip(a, b, strict=True)), set()) and sum(b - a) == len(cover) and (a[1:] > b[:-1]).all()


def brute_matches(data, items, width, slop):
    out = set()
    for item, t in items:
        w = split(t)
        n = min(width, len(w))
        for window in {tuple(w[s : s + n]) for s in range(len(w) - n + 1 if n else 0)}:
            for i, text in data:
                own = split(text)
                phrases = {s for s in range(len(own) - n + 1) if tuple(own[s : s + n]) == window}
                out |= {(i, str(item), s, n, "phrase") for s in phrases}
                loose = [s for s in range(len(own)) if all(x in own[max(0, s + k - slop) : max(0, s + k + slop + 1)] for k, x in enumerate(window))]
                for s in loose:
                    if s - 1 not in loose:
                        run = next(e for e in range(s, len(own) + 1) if e not in loose)
                        if not phrases & set(range(s, run)):
                            out.add((i, str(item), s, n, "proximity"))
    return out


def test_search_equals_brute_force(spark, monkeypatch, tmp_path):
    data, items = case()
    data = [(i, t) for i, t in data if len(t or "") < 2000 and i not in (None, 1, 3)]
    base = split(items[0][1])
    swapped = [*base[:4], base[5], base[4], *base[6:]]
    data += [(900, " ".join([*base[:5], "inserted", *base[5:]])), (901, " ".join(swapped)), (902, " ".join([*base[:5], "instead", *base[6:]]))]
    later = [(50, "only this benchmark has inserted terms"), (51, data[3][1])]
    D.build_index(docs(spark, data + [(903, later[0][1])]).repartition(3), block_bytes=2000).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    data += [(903, later[0][1])]
    for tests, width, slop, step, size in ((items, 10, 1, 1 << 20, 1 << 20), (items, 3, 2, 50, 300), (later, 4, 0, 1 << 20, 1 << 20)):
        monkeypatch.setattr(D, "STEP", step)
        monkeypatch.setattr(D, "ITEM_BYTES", size)
        got = D.search(index, item_table(spark, tests), width, slop).collect()
        want = brute_matches(data, tests, width, slop)
        assert set(map(tuple, got)) == want and len(got) == len(want)
        if width == 10:
            assert {(900, "proximity"), (901, "proximity")} <= {(r.doc_id, r.kind) for r in got}
        elif tests is later:
            assert (903, "50", 0, 4, "phrase") in want
    assert {r.kind for r in D.search(index, item_table(spark, items)).collect()} == {"phrase"}
