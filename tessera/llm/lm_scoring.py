"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class, given what precedes it, times that of its slot among
the class's, given class and what precedes it, times its share of the slot. Classes are hashed
endings of words and the end of a text; slots are hashed words. Both softmaxes are maximum-entropy
models over n-gram and skip features of the two words before: each word, their classes, the two
together, each with a row of weights, hashed where there are many. A frequent word stands for
itself in features, any other for a bucket of endings. A token's share of its slot is its add-one
relative frequency there; a slot holds few words, so the share is that of hash collisions.

Training is distributed: each shard of the corpus counts what follows each context over all its
tokens, takes gradient steps over its distinct contexts from the shared weights, and the shards'
changes are averaged row by row, weighted by how many tokens of a shard met the row. Counts of a
vocabulary that grows with the corpus are gathered by an exchange over the digits of the tokens'
hashes: blocks send their distinct tokens with counts to buckets, groups of blocks are merged
before they are sent on, and totals return the same way. Scoring computes each distinct context of
a block once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T

#: Classes (the end of a text is class 0), and slots of a class.
CLASSES, SLOTS = 64, 64
#: Buckets of endings in a class, by which rarer words are told apart in features; words that stand for themselves.
FINER, FREQUENT = 8, 512
ENDINGS = CLASSES * FINER
SYMBOLS = ENDINGS + FREQUENT
#: Groups of classes, by which a slot's features tell the word before the last.
SKIPPED = 8
#: Rows of weights of the class softmax and of the slot softmax; those beyond the features that have their own are hashed.
CLASS_ROWS, SLOT_ROWS = 1 << 14, 1 << 15
#: Bytes of a word's end that decide its class.
ENDING = 3
#: Rounds of training, passes over a shard's contexts in a round, the size of a step, its contexts, and bytes of text of a shard.
ROUNDS, PASSES, STEP, BATCH, SHARD_BYTES = 1, 2, 1.0, 4096, 24 << 20
#: Bytes of text of which a shard counts contexts at a time.
COUNTED_BYTES = 2 << 20
#: Rows of weights in a row of the table of changes, and shards that are averaged at a time.
ROWS_SENT, SHARDS_AVERAGED = 1024, 256
#: Bytes of text of a block, which is counted and scored as a whole.
BLOCK_BYTES = 4 << 20
#: Blocks that are merged at a time in the exchange of counts, and buckets of a digit of a hash: 2^DIGIT.
MERGED, DIGIT = 256, 8
_END_HASH = np.uint64(0x9D2C5680CA3F1B07)
_CLASS_BITS = np.uint64(CLASSES - 1)
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


# Tokens


@dataclass
class Tokens:
    """The tokens of some texts: the hash of each, with its class in the lowest bits, its bucket of endings, its position in
    its text, and the first token of each text (one more than texts)."""

    word: np.ndarray
    bucket: np.ndarray
    since: np.ndarray
    first: np.ndarray


def _class(word: np.ndarray) -> np.ndarray:
    return (word & _CLASS_BITS).astype(np.int32)


def _slot(word: np.ndarray) -> np.ndarray:
    """The slot is in a hash's highest bits, so that a bucket of the exchange is part of one slot of each class."""
    return (word >> np.uint64(58)).astype(np.int32)


def tokens(column) -> Tokens:
    """The tokens of each text: its words, and an end."""
    data, at = T.flat(column)
    words, endings, counts = [], [], np.zeros(len(at) - 1, np.int64)
    for i, j in T.slices(at):
        low = T.LOWER[data[at[i] : at[j]]]
        starts, ends, first = T.spans(low, at[i : j + 1] - at[i], T.SPACE)
        words.append(T.span_hash(low, starts, ends))
        endings.append(T.span_hash(low, np.maximum(starts, ends - ENDING), ends))
        counts[i:j] = np.diff(first)
    first = np.r_[0, np.cumsum(counts + 1)]
    total = int(first[-1])
    word, bucket = np.full(total, _END_HASH & ~_CLASS_BITS), np.zeros(total, np.uint16)
    inside = np.ones(total, bool)
    inside[first[1:] - 1] = False
    if words:
        # buckets of class 0 are the end's alone
        own = np.uint64(FINER) + T.mix(np.concatenate(endings)) % np.uint64(ENDINGS - FINER)
        bucket[inside] = own
        word[inside] = np.concatenate(words) & ~_CLASS_BITS | own // np.uint64(FINER)
    return Tokens(word, bucket, np.arange(total) - np.repeat(first[:-1], np.diff(first)), first)


def _hashed(x: np.ndarray, salt: int, low: int, high: int) -> np.ndarray:
    return low + (T.mix(x.astype(np.uint64) + np.uint64(salt)) % np.uint64(high - low)).astype(np.int64)


# The model


@dataclass
class Weights:
    """Rows of weights: a class's score is the sum of its weights in the rows of a context's features; likewise a slot's."""

    classes: np.ndarray
    slots: np.ndarray
    #: Hashes of the words that stand for themselves, in order.
    frequent: np.ndarray

    @staticmethod
    def start(counts: np.ndarray, frequent: np.ndarray) -> Weights:
        """Weights that give every class and slot its share of all tokens. counts: classes x slots."""
        out = Weights(np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32), np.sort(frequent))
        out.classes[0] = np.log(counts.sum(1) + 1.0)
        out.slots[:CLASSES] = np.log(counts + 1.0)
        return out

    @cached_property
    def coarse(self) -> np.ndarray:
        """The class of each symbol."""
        return np.r_[np.arange(ENDINGS) // FINER, _class(self.frequent), np.zeros(FREQUENT - len(self.frequent), np.int64)].astype(np.int64)

    def contexts(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """The context of each token's class, and that of its slot, as numbers."""
        symbol = t.bucket.astype(np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, t.word), len(self.frequent) - 1)
            symbol = np.where(self.frequent[at] == t.word, ENDINGS + at, symbol)
        one, two = np.zeros_like(symbol), np.zeros_like(symbol)
        one[1:], two[2:] = symbol[:-1], symbol[:-2]
        one[t.since < 1], two[t.since < 2] = 0, 0
        skipped = self.coarse[two] * SKIPPED // CLASSES
        return two * SYMBOLS + one, (skipped * SYMBOLS + one) * CLASSES + _class(t.word)

    def class_rows(self, context: np.ndarray) -> np.ndarray:
        """Rows of weights: all, the word before, the one before that, their classes, the two together."""
        one, two = context % SYMBOLS, context // SYMBOLS
        own = 1 + 2 * SYMBOLS + CLASSES * CLASSES
        rows = [np.zeros_like(one), 1 + one, 1 + SYMBOLS + two, 1 + 2 * SYMBOLS + self.coarse[one] * CLASSES + self.coarse[two], _hashed(context, 3, own, CLASS_ROWS)]
        return np.stack(rows, 1).astype(np.uint16)

    def slot_rows(self, context: np.ndarray) -> np.ndarray:
        """Rows of weights: the class, with the class before, with a group of classes before that, with the word before."""
        kind, one, skipped = context % CLASSES, context // CLASSES % SYMBOLS, context // CLASSES // SYMBOLS
        own = CLASSES * (1 + CLASSES + SKIPPED)
        rows = [kind, CLASSES + kind * CLASSES + self.coarse[one], CLASSES * (1 + CLASSES) + kind * SKIPPED + skipped, _hashed(one * CLASSES + kind, 7, own, SLOT_ROWS)]
        return np.stack(rows, 1).astype(np.uint16)

    def parts(self, t: Tokens):
        """For classes and slots: the weights, the rows of a context, each token's context, and what follows it."""
        of_class, of_slot = self.contexts(t)
        return (self.classes, self.class_rows, of_class, _class(t.word)), (self.slots, self.slot_rows, of_slot, _slot(t.word))

    def log_probabilities(self, t: Tokens) -> np.ndarray:
        """log10 P(class and slot | what precedes) of each token; each distinct context is computed once."""
        out = np.zeros(len(t.word))
        for weights, rows, context, target in self.parts(t):
            order = np.argsort(context, kind="stable")
            ordered = context[order]
            begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
            cuts = np.r_[begin, len(ordered)]
            for i in range(0, len(begin), 1 << 13):
                j = min(len(begin), i + (1 << 13))
                z = scores(weights, rows(ordered[begin[i:j]]))
                z -= np.log(np.exp(z).sum(1, keepdims=True))
                which = order[cuts[i] : cuts[j]]
                out[which] += z[np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1])), target[which]]
        return out / np.log(10)


def scores(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows' weights, less the greatest of each context."""
    z = weights[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        z += weights[rows[:, k]]
    z -= z.max(1, keepdims=True)
    return z


def descend(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, followed: np.ndarray, size: float) -> None:
    """One step down the gradient of the log loss of contexts; a row's steps shrink with its gradients so far (AdaGrad).

    followed: contexts x outcomes, how often each outcome followed.
    """
    p = np.exp(scores(weights, rows))
    p *= (followed.sum(1) / p.sum(1))[:, None]
    p -= followed
    flat, k = rows.ravel(), rows.shape[1]
    order = np.argsort(flat, kind="stable")
    ordered = flat[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    which = ordered[begin]
    # sums along the rows of the transposed gradient: several times as fast as along its columns
    g = np.add.reduceat(np.take(np.ascontiguousarray(p.T), order // k, axis=1), begin, axis=1).T
    squares[which] += np.einsum("ij,ij->i", g, g)
    weights[which] -= (size / np.sqrt(squares[which]))[:, None] * g


class Learner:
    """What a shard counts, and its own copy of the weights."""

    def __init__(self, start: Weights, size: float = STEP):
        self.start, self.size = start, size
        #: For classes and slots, pieces of (context and outcome as one number, count); the first is in order.
        self.cells: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

    def count(self, t: Tokens) -> None:
        """Adds the tokens: how often each class follows each context, and each slot."""
        for k, (weights, _, context, target) in enumerate(self.start.parts(t)):
            held = self.cells[k]
            held.append(np.unique((context * weights.shape[1] + target).astype(np.int32), return_counts=True))
            # merged when what came since is as much as what is held: few merges, and memory for the distinct cells
            if len(held) > 1 and sum(len(c) for c, _ in held[1:]) > max(1 << 18, len(held[0][0])):
                self.cells[k] = [self._merged(held)]

    @staticmethod
    def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells, n = np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        begin = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        return cells[begin], np.add.reduceat(n[order], begin)

    def changes(self, passes: int = PASSES, seed: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Takes steps over the distinct contexts; then numbered pieces of the weights: tokens that met each row, and its change."""
        number = 0
        for k, (weights, rows) in enumerate(((self.start.classes, self.start.class_rows), (self.start.slots, self.start.slot_rows))):
            cell, n = self._merged(self.cells[k])
            self.cells[k] = []
            context, begin = np.unique(cell // weights.shape[1], return_index=True)
            context = context.astype(np.int64)
            cuts, target = np.r_[begin, len(cell)], cell % weights.shape[1]
            now, squares, met = weights.copy(), np.ones(len(weights), np.float32), np.zeros(len(weights))
            total = np.add.reduceat(n, begin)
            rng = np.random.default_rng(seed)
            for done in range(passes):
                # batches of neighbouring contexts in an order of their own: neighbours share rows, so their sums are cheap
                for i in rng.permutation(-(-len(context) // BATCH)) * BATCH:
                    j = min(len(context), i + BATCH)
                    f, some = rows(context[i:j]), slice(cuts[i], cuts[j])
                    followed = np.zeros((j - i, weights.shape[1]), np.float32)
                    followed[np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1])), target[some]] = n[some]
                    descend(now, squares, f, followed, self.size)
                    if not done:
                        met += np.bincount(f.ravel(), np.repeat(total[i:j], f.shape[1]), len(met))
            for i in range(0, len(now), ROWS_SENT):
                part = slice(i, i + ROWS_SENT)
                yield number, met[part], now[part] - weights[part]
                number += 1


_CHANGE = pa.schema({"shard": pa.int64(), "k": pa.int32(), "met": pa.binary(), "change": pa.binary()})


def _change(shard: int, k: int, met: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([[shard], [k], [met.astype(np.float64).tobytes()], [change.astype(np.float16).tobytes()]], schema=_CHANGE)


def _averaged(sent: DataFrame, shards: int) -> DataFrame:
    """The mean change of each piece over the shards, each row weighted by how often it was met; at most SHARDS_AVERAGED at a time."""

    def add(batches):
        held = None

        def done():
            shard, k, met, total = held
            return _change(shard, k, met, total / np.maximum(met, 1)[:, None])

        for batch in batches:
            for r in batch.to_pylist():
                met = np.frombuffer(r["met"], np.float64)
                change = np.frombuffer(r["change"], np.float16).astype(np.float64).reshape(len(met), -1) * met[:, None]
                if held is not None and held[:2] == (r["shard"], r["k"]):
                    held = (*held[:2], held[2] + met, held[3] + change)
                    continue
                if held is not None:
                    yield done()
                held = (r["shard"], r["k"], met, change)
        if held is not None:
            yield done()

    pieces = -(-(CLASS_ROWS + SLOT_ROWS) // ROWS_SENT)
    while shards > 1:
        groups = -(-shards // SHARDS_AVERAGED)
        grouped = sent.withColumn("was", F.col("shard")).withColumn("shard", F.col("shard") % groups)
        # a group's rows of a piece follow each other, in the order of shards, so sums don't depend on what arrives first
        sent = grouped.repartition(min(pieces * groups, 4096), "shard", "k").sortWithinPartitions("shard", "k", "was").drop("was").mapInArrow(add, "shard long, k int, met binary, change binary")
        shards = groups
    return sent


def train(texts: DataFrame, counts: np.ndarray, frequent: np.ndarray, shards: int, rounds: int = ROUNDS, size: float = STEP) -> Weights:
    """Weights fitted to the rows that learn, of sealed blocks of texts; counts: of all their tokens, by class and slot.

    A shard holds its contexts with counts, one copy of the weights and one block; the driver gets one table of changes, of
    fixed size, a round.
    """
    weights = Weights.start(counts, frequent)
    if not counts.any():
        return weights
    spark = texts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def learn(batches, shared=shared):
            learner = Learner(shared.value, size)
            for batch in batches:
                for blob in batch.column("blob"):
                    table = X.unseal(blob.as_py())
                    for some in T.blocks(table.select(["text"]).filter(table["learn"]).to_batches(), "text", COUNTED_BYTES):
                        learner.count(tokens(some.column("text")))
            shard = TaskContext.get().partitionId()
            for k, met, change in learner.changes() if learner.cells[0] else ():
                if met.any():
                    yield _change(shard, k, met, change)

        sent = texts.select("blob").coalesce(shards).mapInArrow(learn, "shard long, k int, met binary, change binary")
        pieces = [w[i : i + ROWS_SENT] for w in (weights.classes, weights.slots) for i in range(0, len(w), ROWS_SENT)]
        for row in _averaged(sent, shards).select("k", "change").collect():
            pieces[row.k] += np.frombuffer(bytes(row.change), np.float16).reshape(pieces[row.k].shape)
        shared.unpersist()
    return weights


# Counts of the vocabulary


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows (part, blob): sealed tables of doc_id, text and learn, each of a block of rows, whatever their ids."""

    def emit(batches):
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for block in T.blocks(batches, "text", BLOCK_BYTES):
            table = pa.table({"doc_id": block.column("doc_id"), "text": block.column("text").cast(pa.large_string()), "learn": block.column("learn")})
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "blob": pa.array([X.seal(table)], pa.binary())})
            part += 1

    return docs.select("doc_id", "text", "learn").mapInArrow(emit, "part long, blob binary")


_SENT = pa.schema({"part": pa.int64(), "bucket": pa.int64(), "names": pa.binary(), "counts": pa.binary()})
_SENT_SQL = "part long, bucket long, names binary, counts binary"
_TOTAL = pa.schema({"part": pa.int64(), "bucket": pa.int64(), "totals": pa.binary()})
_TOTAL_SQL = "part long, bucket long, totals binary"


def _digits(names: np.ndarray, level: int) -> np.ndarray:
    return ((names >> np.uint64(64 - DIGIT * level)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest needs; the width is a first byte."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or counts.max() < 1 << (8 * w))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[0]}", offset=1).astype(np.int64)


def _send(part: int, bucket: int, names: np.ndarray, counts: np.ndarray, level: int) -> list[tuple]:
    """Rows of the next digit's buckets; names are in order, so a bucket's follow each other."""
    cuts = np.searchsorted(_digits(names, level), np.arange((1 << DIGIT) + 1))
    return [(part, bucket << DIGIT | d, names[a:b].tobytes(), _narrow(counts[a:b])) for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if a < b]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _merge(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Names of each row, the distinct names in order with summed counts, and the number of each row's names among them."""
    names = [np.frombuffer(x.as_py(), np.uint64) for x in table["names"]]
    distinct, number = np.unique(np.concatenate(names), return_inverse=True)
    counts = np.zeros(len(distinct), np.int64)
    np.add.at(counts, number, np.concatenate([_widen(x.as_py()) for x in table["counts"]]))
    return names, distinct, counts, number


def _replies(table: pa.Table, names: list[np.ndarray], totals: np.ndarray, number: np.ndarray) -> list[tuple]:
    out, at = [], 0
    for part, bucket, own in zip(table["part"].to_pylist(), table["bucket"].to_pylist(), names, strict=True):
        out.append((part, bucket, _narrow(totals[number[at : at + len(own)]])))
        at += len(own)
    return out


def tasks(blocks: int) -> int:
    """Tasks among which what belongs to so many blocks is dealt, so that each has a few blocks' share at any size."""
    return max(1, -(-blocks // 4))


def exchange(sent: DataFrame, parts: int, level: int = 1) -> tuple[DataFrame, DataFrame]:
    """Totals of the counts that parts send: rows (part, bucket, totals), in the order of the names sent; and the rows (bucket,
    names, totals) of all names, of which each is in one.

    A bucket of the first digits of a hash takes rows of MERGED parts at a time. If there are more, each group of parts is
    merged to one, which sends its names on to the buckets of the next digit; so a task's rows are bounded at any size, and a
    part sends as many rows as there are buckets of a digit, not as there are parts.
    """
    if parts <= MERGED:

        def settle(key, table: pa.Table) -> pa.Table:
            names, distinct, counts, number = _merge(table)
            rows = [(*r, None) for r in _replies(table, names, counts, number)]
            rows.append((None, table["bucket"][0].as_py(), _narrow(counts), distinct.tobytes()))
            return _table(rows, _TOTAL.append(pa.field("names", pa.binary())))

        out = X.cut(sent.repartition(tasks(parts), "bucket").groupBy("bucket").applyInArrow(lambda k, t: settle(k, t), f"{_TOTAL_SQL}, names binary"))
        return out.where("part is not null").drop("names"), out.where("part is null").select("bucket", "names", "totals")
    groups = -(-parts // (MERGED // 2))
    grouped = sent.withColumn("group", F.pmod(F.xxhash64("part"), F.lit(groups)))

    def merge(key, table: pa.Table) -> pa.Table:
        _, distinct, counts, _ = _merge(table)
        return _table(_send(key[0].as_py(), key[1].as_py(), distinct, counts, level + 1), _SENT)

    def give(key, table: pa.Table, totals: pa.Table) -> pa.Table:
        names, distinct, _, number = _merge(table)
        order = np.argsort(totals["bucket"].to_numpy(), kind="stable")
        back = [_widen(totals["totals"][int(i)].as_py()) for i in order]
        return _table(_replies(table, names, np.concatenate(back), number), _TOTAL)

    grouped = grouped.repartition(tasks(parts), "group", "bucket")
    merged = grouped.groupBy("group", "bucket").applyInArrow(lambda k, t: merge(k, t), _SENT_SQL)
    back, whole = exchange(X.cut(merged), groups, level + 1)
    returned = back.select(F.col("part").alias("group"), F.shiftright("bucket", DIGIT).alias("of"), "bucket", "totals")
    out = grouped.groupBy("group", "bucket").cogroup(returned.repartition(tasks(parts), "group", "of").groupBy("group", "of")).applyInArrow(lambda k, t, r: give(k, t, r), _TOTAL_SQL)
    return X.cut(out), whole


def _by_slot(whole: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and types (known ones) of each class and slot."""

    def emit(batches):
        tokens_, types = np.zeros((CLASSES, SLOTS), np.int64), np.zeros((CLASSES, SLOTS), np.int64)
        for batch in batches:
            for names, totals in zip(batch.column("names"), batch.column("totals"), strict=True):
                word, n = np.frombuffer(names.as_py(), np.uint64), _widen(totals.as_py())
                cell = (word & _CLASS_BITS).astype(np.int64), _slot(word)
                np.add.at(tokens_, cell, n)
                np.add.at(types, cell, n > 0)
        some = np.nonzero(types)
        yield pa.record_batch({"cell": pa.array(some[0] * SLOTS + some[1], pa.int32()), "n": pa.array(tokens_[some]), "v": pa.array(types[some])})

    out = np.zeros((2, CLASSES * SLOTS), np.int64)
    # at most CLASSES x SLOTS rows
    for r in whole.mapInArrow(emit, "cell int, n long, v long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        out[:, r.cell] = r.n, r.v
    return out[0].reshape(CLASSES, SLOTS), out[1].reshape(CLASSES, SLOTS)


def _frequent(whole: DataFrame) -> np.ndarray:
    """The hashes of the FREQUENT words that occur most, the least hashes on ties."""

    def emit(batches):
        for batch in batches:
            for names, totals in zip(batch.column("names"), batch.column("totals"), strict=True):
                word, n = np.frombuffer(names.as_py(), np.uint64), _widen(totals.as_py())
                top = np.lexsort((word, -n))[:FREQUENT]
                top = top[n[top] > 0]
                yield pa.record_batch({"word": pa.array(word[top].view(np.int64)), "n": pa.array(n[top])})

    found = whole.mapInArrow(emit, "word long, n long").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    return np.array([r.word for r in found], np.int64).view(np.uint64)


# Scoring


def _learns(table: pa.Table) -> np.ndarray:
    return table["learn"].to_numpy(zero_copy_only=False).astype(bool)


def training_rows(doc_id: str = "doc_id"):
    """Rows to learn from: those whose crc32 of the doc_id as text doesn't leave 2 divided by 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 != 2, F.lit(True))


def shares(count: np.ndarray, word: np.ndarray, n: np.ndarray, v: np.ndarray) -> np.ndarray:
    """log10 of a token's share of its slot: add-one, with one more type for all unknown ones."""
    cell = (word & _CLASS_BITS).astype(np.int64), _slot(word)
    return np.log10((count + 1) / (n[cell] + v[cell] + 1))


def score(docs: DataFrame, learn=None, rounds: int = ROUNDS) -> DataFrame:
    """Scores of whole texts: the add-one unigram base and the model's log10 probability.

    docs: doc_id, text; learn: the rows to learn from, by default `training_rows()`. Words are lower-cased in A-Z; a null or
    empty text is its end alone. A token that no training text has counts as one unknown token, in the base and in each
    slot. Rows that share a doc_id are scored, and counted, each by itself; a null doc_id is learnt from. Without rows to
    learn from all tokens are unknown. An empty table gives no rows. A text may be of any length.
    """
    learn = training_rows() if learn is None else learn
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn"))
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    texts = X.cut(_blocks(docs))

    def count(batches):
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                table = X.unseal(blob.as_py())
                t = tokens(table["text"])
                names, number = np.unique(t.word, return_inverse=True)
                n = np.bincount(number[np.repeat(_learns(table), np.diff(t.first))], minlength=len(names))
                yield from _table(_send(part, 0, names, n, 1), _SENT).to_batches()

    # blocks hold so many bytes, or the rows of an Arrow batch; an estimate is enough to choose the levels of the exchange
    parts = int(size) // BLOCK_BYTES + int(rows) // 10_000 + 1
    totals, whole = exchange(texts.mapInArrow(count, _SENT_SQL), parts)
    n, v = _by_slot(whole)
    weights = train(texts, n, _frequent(whole), max(1, -(-int(size) // SHARD_BYTES)), rounds)
    shared = docs.sparkSession.sparkContext.broadcast((weights, n, v))

    def finish(key, table: pa.Table, replies: pa.Table) -> pa.Table:
        weights, n, v = shared.value
        table = X.unseal(table["blob"][0].as_py())
        t = tokens(table["text"])
        names, number = np.unique(t.word, return_inverse=True)
        order = np.argsort(replies["bucket"].to_numpy(), kind="stable")
        known = np.concatenate([_widen(replies["totals"][int(i)].as_py()) for i in order])
        base = np.log10((known + 1) / (n.sum() + v.sum() + 1))[number]
        own = weights.log_probabilities(t) + shares(known, names, n, v)[number]
        sums = lambda x: np.add.reduceat(x, t.first[:-1])  # noqa: E731  every text has its end
        return pa.table({
            "doc_id": table["doc_id"], "held_out": pa.array(~_learns(table)), "n_tokens": pa.array(np.diff(t.first), pa.int64()),
            "n_known": pa.array(sums((known > 0)[number].astype(np.int64)), pa.int64()), "train_tokens": pa.array(np.full(len(table), int(n.sum())), pa.int64()),
            "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(sums(own), pa.float64()),
        })

    texts, totals = (x.repartition(tasks(parts), "part") for x in (texts, totals))
    return texts.groupBy("part").cogroup(totals.groupBy("part")).applyInArrow(lambda k, t, r: finish(k, t, r), RESULT)
