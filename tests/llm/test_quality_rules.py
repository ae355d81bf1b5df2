import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality_rules as Q

from .common import DOCS, docs, rows


def brute(t):
    t = t or ""
    split = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    cover = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            cover |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def test_counts_equal_brute_force(spark):
    data = [*rows(13, 50), (900, "a\na\n\n a\nb | c\n\r\n\r\na"), (901, "x y z x y z x y z x y z"), (902, "#é*$%&|<>日本")]
    out = Q.judge(docs(spark, data).repartition(3)).collect()
    got = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out], key=str)
    assert got == sorted([(i, *brute(t)) for i, t in data], key=str)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert Q.judge(docs(spark, [])).collect() == []


@pytest.mark.parametrize("broadcast, block", [(5000, 20_000), (0, 20_000), (5000, 100)])
def test_junk_goes_and_clean_documents_stay(spark, monkeypatch, broadcast, block):
    monkeypatch.setattr(Q, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(Q, "BLOCK_ROWS", block)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("distance", Q.F.lit("x")).withColumn("kept", Q.F.lit(0))
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = Q.judge(d)
    out = [r for r in judged.collect() if r.doc_id in labels]
    junk, clean = [r for r in out if not labels[r.doc_id]], [r for r in out if labels[r.doc_id] and not r.base_failed]
    assert np.mean([r.kept for r in clean]) > 0.995 and np.mean([r.kept for r in junk]) < 0.1
    sums = Q.rejections(judged).agg(*(Q.F.sum(c) for c in ("n", "n_failed", "n_outliers"))).first()
    assert tuple(sums) == (d.count(), judged.where("base_failed").count(), judged.where("not base_failed and not kept").count())


def plain(x, h):
    """The least determinant over all subsets of h rows."""
    best = (math.inf,)
    for some in itertools.combinations(range(len(x)), h):
        y = x[list(some)]
        d = y - y.mean(0)
        s = Q.scatter_of(d.T @ d / h, h / len(x))
        best = min(best, (np.linalg.slogdet(s)[1], some))
    return best


def test_least_determinant_of_all_subsets():
    rng = np.random.default_rng(5)
    for n, p, far in ((9, 2, 2), (11, 2, 3), (12, 3, 2), (10, 1, 2)):
        x = rng.normal(size=(n, p)) + np.where(np.arange(n)[:, None] < far, 6, 0)
        h = Q.covered(n, p)
        det, some = plain(x, h)
        mean, _, found = Q.least_determinant(x)
        assert abs(found - det) < 1e-9 and np.allclose(mean, x[list(some)].mean(0))


def test_steps_over_all_rows_equal_steps_in_memory(spark, monkeypatch):
    rng = np.random.default_rng(6)
    k = len(Q.DIMENSIONS)
    x = rng.normal(size=(400, k)) * np.arange(1, k + 1)
    x[:60] += 20
    start = Q.least_determinant(x[::5])
    rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "key string, " + ", ".join(f"{c} double" for c in Q.DIMENSIONS))
    now = spark.createDataFrame([Q._estimate("g", len(x), *start)], Q._ESTIMATE)
    (got,) = Q._step(rows, now, Q.F.broadcast).collect()
    h = Q.covered(len(x), k)
    near = x[np.argsort(Q.squared(x, *start[:2]), kind="stable")[:h]]
    d = near - near.mean(0)
    assert np.allclose(got.mean, near.mean(0)) and np.allclose(np.array(got.scatter).reshape(k, k), Q.scatter_of(d.T @ d / h, h / len(x)))
    # in blocks of 50 rows, until it converges, about what all rows at once give
    monkeypatch.setattr(Q, "BLOCK_ROWS", 50)
    sizes = spark.createDataFrame([("g", len(x))], "key string, n long")
    (got,) = Q.estimates(rows.withColumn("spot", Q.F.rand(1)).checkpoint(), sizes, True).collect()
    assert abs(got.det - Q.least_determinant(x)[2]) < 0.05


def test_chi_square():
    """Values of the usual tables."""
    assert abs(Q.chi_quantile(0.999, 7) - 24.322) < 1e-3 and abs(Q.chi_quantile(0.95, 1) - 3.841) < 1e-3 and abs(Q.chi_share(9.037, 7) - 0.75) < 1e-4 and Q.chi_share(0, 3) == 0


def test_small_groups_are_drawn_to_wider_ones(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(80))
    data = [(i, text(), lang, source, 1, "", "", "") for i, (lang, source) in enumerate([("en", "big")] * 60 + [("en", "tiny")] * 3 + [(None, None)] * 4)]
    data.append((500, "#$% " * 5 + " ".join(f"{k}&*" for k in range(80)), "en", "tiny", 1, "", "", ""))
    out = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(data, DOCS)).collect()}
    assert not out.pop(500) and all(out.values())
    few = Q.judge(spark.createDataFrame(data[-10:], DOCS)).collect()
    assert all(r.kept and r.distance == 0 for r in few)
    one = (np.zeros(2), np.eye(2))
    assert Q.mixed(None, 5, one) is one and Q.mixed(one, 5, None) is one and Q.mixed(None, 5, None) is None
    mean, scatter = Q.mixed((np.ones(2), np.eye(2)), Q.PRIOR_ROWS, one)
    assert np.allclose(mean, 0.5) and np.allclose(scatter, np.eye(2) + 0.25)


def plain_judge(stats, groups):
    """kept by the definitions, in memory: stats are vectors of the rows that pass the base rules, by their group."""
    keys = [[("a",), ("l", g[0]), ("s", *g)] for g in groups]
    own = {}
    for key in {k for ks in keys for k in ks}:
        x = stats[[key in ks for ks in keys]]
        if len(x) >= Q.LEAST_ROWS:
            own[key] = (*Q.least_determinant(x)[:2], len(x))
    out = []
    for x, ks in zip(stats, keys, strict=True):
        now = None
        for key in ks:
            if key in own:
                now = Q.mixed(own[key][:2], own[key][2], now)
        out.append(now is None or Q.squared(x[None], *now)[0] <= Q.chi_quantile(Q.QUANTILE, len(x)))
    return out


def test_kept_equals_a_plain_version(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    passed = Q.measure(d).withColumn("base_failed", Q.base_failed()).select("*", *Q.vectors()).where("not base_failed").collect()
    want = plain_judge(np.array([[r[c] for c in Q.DIMENSIONS] for r in passed]), [(r.lang, r.source) for r in passed])
    got = {r.doc_id: r.kept for r in Q.judge(d).collect() if not r.base_failed}
    assert got == dict(zip([r.doc_id for r in passed], map(bool, want), strict=True)) and not all(want)
