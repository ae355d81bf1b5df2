import random

from tessera.llm import line_dedup as L

from .common import docs, rows, words

SPACE = " \t\n\x0b\f\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    if a == b:
        return True
    return min(len(a), len(b)) >= L.LEAST_NEAR and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1


def brute(data):
    """data: distinct doc_ids. Every line against all earlier ones."""
    seen, out = [], {}
    for i, t in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        kept = []
        for piece in (t or "").split("\n"):
            s = piece.strip(SPACE)
            if len(s) < L.LEAST:
                kept.append(piece)
                continue
            if not any(near(s, x) for x in seen):
                kept.append(piece)
            seen.append(s)
        out[i] = None if t is None else "\n".join(kept)
    return out


def case(seed=1):
    rng = random.Random(seed)
    pool = [words(rng, rng.choice([2, 4, 7, 12, 20]), 300) for _ in range(25)] + ["été ñandú 日本語の行 číslo ěščř 🙂 konec", "x" * 40, "x" * 41, "ab" * 15, "12345678901234567890", "1234567890123456789", "short", "   ", ""]
    data = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            s = rng.choice(pool)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(s) + 1), rng.choice("qé🙂")
                s = rng.choice([s[:k] + c + s[k:], s[:k] + s[k + 1 :], s[:k] + c + s[k + 1 :]])
            lines.append(rng.choice(["", " ", "\t"]) + s + rng.choice(["", "\r"]))
        data.append((i * 3 % 61, "\n".join(lines)))
    return [*data, (500, None), (501, ""), (502, "\n\n"), (None, pool[3] + "\n" + pool[4])]


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        data = case(seed)
        for parts in (1, 7):
            out = L.dedup_lines(docs(spark, data).repartition(3), parts=parts).collect()
            assert {r.doc_id: r.text for r in out} == brute(data)
            assert all(r.part == "p" and r.source == "src0" and (r.text is None or r.n_chars == len(r.text)) for r in out)


def test_odd_rows(spark):
    data = rows(7)
    out = L.dedup_lines(docs(spark, data)).collect()
    assert len(out) == len(data)
    twice = [r.text for r in out if r.doc_id == 1]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert L.dedup_lines(docs(spark, [])).collect() == []
    kept = L.drop_emptied(L.dedup_lines(docs(spark, [(1, "one line that is long enough"), (2, "one line that is long enough"), (3, None), (4, "")])), ["doc_id", "text"])
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_counts(spark):
    data = [(1, "a line of some length here\n\nb"), (2, "a line of some length here\nA line of some length here\nnew line of another kind")]
    out = {r.doc_id: (r.n_lines, r.n_removed, r.text_sha256) for r in L.digests(L.dedup_lines(docs(spark, data))).collect()}
    assert out == {1: (2, 0, L.sha256(data[0][1])), 2: (3, 2, L.sha256("new line of another kind"))}


def test_short_lines_are_judged(spark):
    rng = random.Random(4)
    # one edit apart and long enough are the last two alone
    pool = ["Les.", "Lis.", "And ornd.", "And ornt.", "x", "}", "é", "日本", "🙂", "w1 w2", "With and to.", "With, and to."]
    data = [(i, "\n".join(rng.choice([s, " " + s + "\t", ""]) for s in rng.choices(pool, k=4))) for i in range(30)]
    seen, want = set(), {}
    for i, t in data:
        kept = []
        for piece in t.split("\n"):
            s = piece.strip(SPACE).replace("With,", "With")
            if not s or s not in seen:
                kept.append(piece)
            seen.add(s)
        want[i] = "\n".join(kept)
    assert {r.doc_id: r.text for r in L.dedup_lines(docs(spark, data).repartition(3), parts=3).collect()} == want
