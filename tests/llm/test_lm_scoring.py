import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import lm_scoring as L

from .common import docs, rows

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)), 0]


def brute(data):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in data if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return sorted([(i, held(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in data], key=str)


def base(out):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out], key=str)


def test_base_equals_brute_force(spark):
    for data in (rows(11, 50), []):
        out = L.score(docs(spark, data).repartition(3)).collect()
        assert base(out) == brute(data)
        assert all(r.score < 0 or r.n_tokens == 1 for r in out)


def test_counts_by_several_levels_of_the_exchange(spark, monkeypatch):
    """Groups of two blocks merge, and merge again, before totals are known; every block is one document."""
    monkeypatch.setattr(L, "MERGED", 4)
    monkeypatch.setattr(L, "BLOCK_BYTES", 100)
    levels = []
    inner = L.exchange
    monkeypatch.setattr(L, "exchange", lambda sent, parts, level=1: levels.append(level) or inner(sent, parts, level))
    data = rows(5, 12)
    data = [r for r in data if len(r[1] or "") < 3000]
    assert base(L.score(docs(spark, data).repartition(3)).collect()) == brute(data)
    assert max(levels) >= 2


def test_nothing_to_learn_from(spark):
    from pyspark.sql import functions as F

    out = L.score(docs(spark, [(1, "a b"), (2, None)]), learn=F.lit(False)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in out)


def random_weights(seed=3, frequent=()):
    rng = np.random.default_rng(seed)
    return L.Weights(rng.normal(size=(L.CLASS_ROWS, L.CLASSES)).astype(np.float32), rng.normal(size=(L.SLOT_ROWS, L.SLOTS)).astype(np.float32), np.sort(np.array(frequent, np.uint64)))


def test_probabilities_sum_to_one():
    """Over all classes and slots after some context, and over a slot's tokens and the unknown one."""
    n = L.CLASSES * L.SLOTS
    cell = np.arange(n, dtype=np.uint64)
    word = np.tile(np.array([641, 1282, 0], np.uint64), n)
    word[2::3] = (cell // L.CLASSES) << np.uint64(58) | cell % L.CLASSES
    t = L.Tokens(word, np.tile(np.array([8, 19, 0], np.uint16), n), np.tile(np.arange(3), n), np.arange(0, 3 * n + 1, 3))
    assert abs((10.0 ** random_weights(frequent=[1282]).log_probabilities(t)[2::3]).sum() - 1) < 1e-4
    count = np.array([5, 1, 9])
    total, types = np.zeros((L.CLASSES, L.SLOTS), int), np.zeros((L.CLASSES, L.SLOTS), int)
    word = np.array([2, 2, 2], np.uint64) | np.uint64(1) << np.uint64(58)
    total[2, 1], types[2, 1] = count.sum(), 3
    known = 10.0 ** L.shares(count, word, total, types)
    assert abs(known.sum() + 10.0 ** L.shares(np.zeros(1, int), word[:1], total, types)[0] - 1) < 1e-9


def one_hash(b: bytes) -> int:
    data = np.frombuffer(b, np.uint8)
    return int(L.T.span_hash(data, np.zeros(1, np.int64), np.array([len(b)]))[0])


def mixed(x: int) -> int:
    return int(L.T.mix(np.array([x % 2**64], np.uint64))[0])


def plain_word(x: str | None) -> tuple[int, int]:
    """The hash of a word, or of the end, and its bucket of endings."""
    if x is None:
        return int(L._END_HASH) // 64 * 64, 0
    bucket = 8 + mixed(one_hash(x.encode()[-3:])) % (64 * 8 - 8)
    return one_hash(x.encode()) // 64 * 64 + bucket // 8, bucket


def plain_score(w, texts, counts, total, types):
    """The model's formula, a token at a time."""
    frequent = {int(x): 512 + i for i, x in enumerate(w.frequent)}
    kind = {i: i // 8 for i in range(512)} | {s: x % 64 for x, s in frequent.items()}
    out = []
    for text in texts:
        one = two = 0
        sum_ = 0.0
        for x in [*split(text)[:-1], None]:
            word, bucket = plain_word(x)
            cls, slot = word % 64, word >> 58
            z = sum(w.classes[r].astype(float) for r in (0, 1 + one, 1025 + two, 2049 + kind[one] * 64 + kind[two], 6145 + mixed(two * 1024 + one + 3) % (L.CLASS_ROWS - 6145)))
            y = sum(w.slots[r].astype(float) for r in (cls, 64 + cls * 64 + kind[one], 4160 + cls * 8 + kind[two] // 8, 4672 + mixed(one * 64 + cls + 7) % (L.SLOT_ROWS - 4672)))
            sum_ += (z[cls] - math.log(np.exp(z).sum()) + y[slot] - math.log(np.exp(y).sum())) / math.log(10)
            sum_ += math.log10((counts[x] + 1) / (total[cls, slot] + types[cls, slot] + 1))
            one, two = frequent.get(word, bucket), one
        out.append(sum_)
    return out


def test_score_equals_a_plain_scorer_with_the_same_weights(spark, monkeypatch):
    made = []
    monkeypatch.setattr(L, "train", lambda texts, n, frequent, *a: made.append(random_weights(frequent=frequent)) or made[-1])
    data = [(i, t) for i, t in rows(7, 12) if i is not None and len(t or "") < 4000]
    learnt = [t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(None if x == 0 else x for t in learnt for x in split(t))
    total, types = np.zeros((L.CLASSES, L.SLOTS)), np.zeros((L.CLASSES, L.SLOTS))
    for x, n in counts.items():
        word, _ = plain_word(x)
        total[word % 64, word >> 58] += n
        types[word % 64, word >> 58] += 1
    got = L.score(docs(spark, data)).collect()
    assert set(made[0].frequent.tolist()) == {plain_word(x)[0] for x, _ in sorted(counts.items(), key=lambda c: (-c[1], np.uint64(plain_word(c[0])[0]).view(np.int64)))[:512]}
    assert np.allclose(sorted(r.score for r in got), sorted(plain_score(made[0], [t for _, t in data], counts, total, types)), rtol=1e-4)


def test_a_shard_counts_every_token_in_its_context():
    w = random_weights(frequent=[plain_word("a")[0]])
    learner = L.Learner(w)
    texts = ["a b a c a b", "", "b a", "a b"]
    learner.count(L.tokens(pa.array(texts[:2])))
    learner.count(L.tokens(pa.array(texts[2:])))
    want = [Counter(), Counter()]
    for text in texts:
        one = two = 0
        for x in [*split(text)[:-1], None]:
            word, bucket = plain_word(x)
            want[0][(two * 1024 + one) * 64 + word % 64] += 1
            group = (two // 8 if two < 512 else plain_word("a")[0] % 64) // 8
            want[1][((group * 1024 + one) * 64 + word % 64) * 64 + (word >> 58)] += 1
            one, two = (512 if x == "a" else bucket), one
    for held, expected in zip(learner.cells, want, strict=True):
        got = Counter()
        for cells, n in held:
            got.update(dict(zip(cells.tolist(), n.tolist(), strict=True)))
        assert got == expected


def test_steps_descend_the_gradient():
    """The change of one step of one batch is the gradient by finite differences, over the root of its squares."""
    w = random_weights()
    rng = np.random.default_rng(1)
    f = w.class_rows(rng.integers(0, 40, 12))
    followed = rng.integers(0, 4, (12, L.CLASSES)).astype(float)
    weights = w.classes.astype(np.float64)

    def loss(x):
        z = L.scores(x, f)
        return -(followed * (z - np.log(np.exp(z).sum(1, keepdims=True)))).sum()

    for row in (0, int(f[1, 1])):
        grad = np.array([(loss(weights + d) - loss(weights - d)) / 2e-5 for c in range(L.CLASSES) for d in [np.eye(1, weights.size, row * L.CLASSES + c).reshape(weights.shape) * 1e-5]])
        after = weights.copy()
        L.descend(after, np.ones(len(weights)), f, followed, 1.0)
        assert np.allclose(weights[row] - after[row], grad / np.sqrt(1 + (grad**2).sum()), atol=1e-5)


def test_shards_changes_are_averaged_by_how_often_rows_were_met(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARDS_AVERAGED", 2)
    rng = np.random.default_rng(2)
    met, change = rng.integers(0, 5, (5, 3, 4)), rng.normal(size=(5, 3, 4, 2)).astype(np.float16)
    sent = spark.createDataFrame([(s, k, bytearray(met[s, k].astype(float).tobytes()), bytearray(change[s, k].tobytes())) for s in range(5) for k in range(3)], "shard long, k int, met binary, change binary")
    want = (change.astype(float) * met[..., None]).sum(0) / np.maximum(met.sum(0), 1)[..., None]
    got = {r.k: np.frombuffer(bytes(r.change), np.float16).reshape(4, 2) for r in L._averaged(sent, 5).collect()}
    assert np.allclose([got[k] for k in range(3)], want, atol=5e-3)


def test_beats_the_base_on_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for rounds in (0, 1):
        held = [r for r in L.score(d, rounds=rounds).collect() if r.held_out]
        assert len(held) > 80
        gains.append((sum(r.score for r in held) - sum(r.base_score for r in held)) / sum(r.n_tokens for r in held))
    # without a round the model is the classes' and slots' own shares, about the base
    assert gains[0] < 0.05 and gains[1] > 0.2


@pytest.mark.parametrize("text", ["x " * 50_000, "word"])
def test_long_and_short(spark, text):
    (r,) = L.score(docs(spark, [(1, text)])).collect()
    assert r.n_tokens == len(text.split()) + 1
