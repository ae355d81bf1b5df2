import hashlib
import re

from tessera.llm.substring_dedup import remove_repeats

from .common import docs, rows


def brute(data, width):
    """By the definition: the earliest (doc_id, start) of each window keeps its words."""
    texts = {}
    for i, t in data:
        texts.setdefault((i is not None, i or 0), []).append(t or "")
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", v[0]) for k, v in texts.items()}
    first, out = {}, {}
    for k in sorted(split):
        w = split[k]
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first.setdefault(tuple(w[s : s + width]), (k, s)) != (k, s):
                gone[s : s + width] = [True] * width
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[k[1] if k[0] else None] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_equals_brute_force(spark):
    data = [x for x in rows(3, 60) if x[0] is not None]
    data = list(dict(data[::-1]).items())
    for width in (20, 3):
        for parts in (1, 5):
            got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs(spark, data).repartition(3), width, parts).collect()}
            assert got == brute(data, width)


def test_odd_rows(spark):
    data = rows(2)
    out = remove_repeats(docs(spark, data), 20).collect()
    assert len(out) == len(data)
    same = [r for r in out if r.doc_id == 1]
    assert len(same) == 2 and same[0] == same[1]
    assert remove_repeats(docs(spark, []), 20).collect() == []


def test_runs_inside_one_document(spark):
    text = " ".join(["a b c d"] * 20)
    (row,) = remove_repeats(docs(spark, [(1, text)]), 20).collect()
    assert (row.n_words, row.n_removed, row.kept) == (80, 76, "a b c d")
