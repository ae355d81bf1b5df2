"""MinHash near-dedup with tensored banding.

Each distinct shingle set gets two collections of SUB small hashes, each of ROWS minhash values.
A table's key combines one hash of either collection, so 2 x SUB x ROWS minhash functions make
SUB^2 tables of 2 x ROWS rows. At similarity s a pair shares no table with probability
1 - (1 - (1 - s^ROWS)^SUB)^2: 2e-5 at 0.8.

Sets that share a key are candidates. No bucket emits all its pairs: its members are paired with two
anchors, the one nearest to the members' consensus and a random one, pairs are confirmed on full
sets, and components are built; this twice, with the first anchor alone and with both. Then only members of one bucket that are still in
different components, and that sizes and sketches allow, have to be compared: the set of the one in
the smaller component goes once to each part where such others are, and is compared there. Every
candidate pair is thus confirmed, refuted or already connected, and no table of pairs is made.

Sets travel as compressed blocks: texts are dealt to parts once, a set goes once to each part that
needs it, and is compared there. Equal sets are one node, known by a 64-bit hash of the set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T
from .components import components

SUB, ROWS = 16, 3
_FUNCTIONS = 2 * SUB * ROWS
_MULTIPLIERS = np.random.default_rng(77).integers(1, 1 << 63, _FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Of the minhash functions' 2-bit values, so many must agree; at similarity 0.8 fewer do with a chance of about 1e-8.
SKETCH_LEAST = 60
#: Keys in a bucket of the exchange of keys, about.
BUCKET_KEYS = 2_000_000
BLOCK = 4 << 20
_DOC_BITS = np.uint64(48)
_LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes of each text, sorted, and where each text's begin (one more than texts)."""
    words, first = T.hash_words(column, T.SPACE, lower=True)
    n = len(first) - 1
    at = T.windows(first, width)
    doc = np.searchsorted(first, at, "right") - 1
    h = T.rolling(words, width)[at] if len(at) else np.zeros(0, np.uint64)
    lengths = np.diff(first)
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):  # fewer words than a shingle: the whole sequence
        whole = [int(T.mix(T.rolling(words[first[i] : first[i + 1]], int(lengths[i])) + np.uint64(lengths[i]))[0]) for i in short]
        doc, h = np.r_[doc, short], np.r_[h, np.array(whole, np.uint64)]
    out, counts = [], np.zeros(n, np.int64)
    for low in range(0, n, 1 << 16):  # so many texts fit in the upper bits
        own = (doc >= low) & (doc < low + (1 << 16)) if n > 1 << 16 else slice(None)
        keys = ((doc[own] - low).astype(np.uint64) << _DOC_BITS) | (h[own] & _LOW48)
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]] if len(keys) else keys
        counts[low : low + (1 << 16)] += np.bincount((keys >> _DOC_BITS).astype(np.int64), minlength=min(n - low, 1 << 16))
        out.append(keys & _LOW48)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.r_[0, np.cumsum(counts)]


def set_ids(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for empty ones only."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(T.mix(sets + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
    out = T.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    out[np.diff(first) == 0] = 0
    return out.view(np.int64)


def signatures(sets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: the small hashes (texts x 2 SUB) and the sketch (texts x bytes, 2 bits of each minhash)."""
    n = len(first) - 1
    low = np.empty((n, _FUNCTIONS), np.uint64)
    spread = T.mix(sets)
    for k in range(_FUNCTIONS):
        low[:, k] = np.minimum.reduceat(spread * _MULTIPLIERS[k], first[:-1])
    mixed = T.mix(low)
    small = np.zeros((n, 2 * SUB), np.uint64)
    for r in range(ROWS):
        small = T.mix(small + mixed[:, r :: ROWS])
    two = ((mixed >> np.uint64(40)) & np.uint64(3)).astype(np.uint8).reshape(n, -1, 4)
    return small, two[:, :, 0] | two[:, :, 1] << 2 | two[:, :, 2] << 4 | two[:, :, 3] << 6


_POP = np.array([sum(((i >> s) & 3) == 0 for s in (0, 2, 4, 6)) for i in range(256)], np.uint8)


def sketch_allows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _POP[a ^ b].sum(1) >= SKETCH_LEAST


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document: doc_id, tag, n (set size), sid (set's hash, null if empty), small, sketch."""

    def emit(batches):
        for block in T.blocks(batches, "text", BLOCK):
            sets, first = shingle_sets(block.column("text"), width)
            sid, n = set_ids(sets, first), np.diff(first)
            some = np.flatnonzero(n)
            small = sketch = None
            at_small = np.cumsum(np.r_[0, np.where(n > 0, 16 * SUB, 0)])
            at_sketch = np.cumsum(np.r_[0, np.where(n > 0, _FUNCTIONS // 4, 0)])
            small, sketch = signatures(sets, np.r_[first[some], first[-1]]) if len(some) else (np.zeros(0, np.uint64), np.zeros(0, np.uint8))
            yield pa.record_batch({
                "doc_id": block.column("doc_id"), "tag": block.column("tag"), "n": pa.array(n, pa.int64()),
                "sid": pa.array(sid, pa.int64(), mask=n == 0),
                "small": T.binaries(None, small.reshape(-1).view(np.uint8), at_small), "sketch": T.binaries(None, sketch.reshape(-1), at_sketch),
            })

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    return own.mapInArrow(emit, "doc_id long, tag long, n long, sid long, small binary, sketch binary")


def _buckets(nodes: DataFrame, spread: int) -> DataFrame:
    """A row for each bucket: its groups of two or more sets with equal keys, as numbers into a list of ids.

    A bucket holds the tables of one small hash of the first collection, and a share of its values: so a set goes to SUB
    buckets, however many there are, and brings the second collection once. Of that, 16 bits of each hash are compared, and
    40 of the first: a few pairs for each bucket that share no key are candidates too.
    """

    def emit(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                sid = np.asarray(part.column("sid"))
                small = np.frombuffer(b"".join(part.column("small").to_pylist()), np.uint64).reshape(part.num_rows, 2 * SUB)
                second = (small[:, SUB:] >> np.uint64(48)).astype(np.uint16)
                for i in range(SUB):
                    first = small[:, i]
                    share = (first >> np.uint64(40)) % np.uint64(spread)
                    for b, which in X.grouped((i * spread + share).astype(np.int32)):
                        own = first[which]
                        raw = [own.astype(np.uint32).tobytes(), (own >> np.uint64(32)).astype(np.uint8).tobytes(), second[which].tobytes(), sid[which].tobytes()]
                        yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["bucket", "low", "high", "second", "sids"])

    def settle(key, table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[c]])
        first = read("high", np.uint8).astype(np.uint64) << np.uint64(32) | read("low", np.uint32)
        order = np.argsort(first)
        equal = first[order[1:]] == first[order[:-1]]
        order = order[np.r_[equal, False] | np.r_[False, equal]]
        sid = np.repeat(read("sids", np.int64)[order], SUB)
        second = read("second", np.uint16).reshape(-1, SUB)[order].astype(np.uint64)
        keys = T.mix(T.mix(first[order])[:, None] + (np.arange(SUB, dtype=np.uint64) << np.uint64(16)) + second).reshape(-1)
        if not len(keys):
            return pa.Table.from_batches([], _GROUPS)
        order = np.argsort(keys)
        keys = keys[order]
        equal = keys[1:] == keys[:-1]
        many = np.r_[equal, False] | np.r_[False, equal]
        sid, keys = sid[order[many]], keys[many]
        if not len(sid):
            return pa.Table.from_batches([], _GROUPS)
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begin, len(sid)])
        # a pair shares many tables: groups of the same members count once
        name = np.add.reduceat(T.mix(sid.view(np.uint64)), begin) + size.astype(np.uint64)
        keep = np.zeros(len(begin), bool)
        keep[np.unique(name, return_index=True)[1]] = True
        sid = sid[np.repeat(keep, size)]
        ids, at = np.unique(sid, return_inverse=True)
        sealed = [X.seal(pa.table({"n": size[keep].astype(np.uint32)})), X.seal(pa.table({"at": at.astype(np.uint32)}))]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([ids], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in sealed)], schema=_GROUPS)

    sent = nodes.mapInArrow(emit, "bucket int, low binary, high binary, second binary, sids binary")
    return X.dealt(sent, SUB * spread, "bucket").groupBy("bucket").applyInArrow(lambda k, t: settle(k, t), "bucket int, ids array<long>, sizes binary, members binary")


_GROUPS = pa.schema({"bucket": pa.int32(), "ids": pa.list_(pa.int64()), "sizes": pa.binary(), "members": pa.binary()})


def _part(column, parts: int):
    return F.pmod(F.col(column), F.lit(parts)).cast("int")


def _sets(blobs, wanted: np.ndarray, width: int):
    """(sid, set) of the wanted sets among the sealed texts of a part."""
    for blob in blobs:
        table = X.unseal(blob.as_py())
        sid = table["sid"].to_numpy()
        rows = np.flatnonzero(np.isin(sid, wanted))
        if len(rows):
            own = table.take(pa.array(rows))
            for i, j in T.slices(np.r_[0, np.cumsum([len(x or "") for x in own["text"].to_pylist()])], BLOCK):
                sets, first = shingle_sets(own["text"].slice(i, j - i), width)
                for k in range(j - i):
                    yield int(sid[rows[i + k]]), sets[first[k] : first[k + 1]]


def _similar(own: np.ndarray, other: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets have that Jaccard similarity, in percent."""
    at = np.searchsorted(other, own)
    both = int(np.count_nonzero(other[np.minimum(at, len(other) - 1)] == own))
    return 100 * both >= similarity * (len(own) + len(other) - both)


class _Forest:
    """Links of a task that join what it hasn't joined yet."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def _root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = self.parent[up]
            x = up
        return x

    def joined(self, a: int, b: int) -> bool:
        return self._root(a) == self._root(b)

    def join(self, a: int, b: int) -> None:
        self.parent[self._root(a)] = self._root(b)
        self.links.append((a, b))

    def table(self) -> pa.Table:
        return pa.table({"a": pa.array([a for a, _ in self.links], pa.int64()), "b": pa.array([b for _, b in self.links], pa.int64())})


def _confirm(pairs: DataFrame, texts: DataFrame, parts: int, width: int, similarity: int) -> DataFrame:
    """Pairs (a, b) whose full sets have the similarity: those of a spanning forest in each part. texts: sealed (sid, text)."""
    pairs = X.cut(pairs.coalesce(parts))
    texts = X.dealt(texts, parts, "part")
    asked = pairs.select(_part("a", parts).alias("part"), "a", _part("b", parts).alias("to")).distinct()

    def send(key, blobs: pa.Table, asked: pa.Table) -> pa.Table:
        targets: dict[int, list[int]] = {}
        for a, to in zip(asked["a"].to_pylist(), asked["to"].to_pylist(), strict=True):
            targets.setdefault(a, []).append(to)
        part, ids, sets = [], [], []
        for sid, own in _sets(blobs["blob"], np.array(list(targets), np.int64), width):
            raw = own.tobytes()
            for to in targets[sid]:
                part.append(to)
                ids.append(sid)
                sets.append(raw)
        return pa.table([pa.array(part, pa.int32()), pa.array(ids, pa.int64()), pa.array([None] * len(ids), pa.int64()), pa.array(sets, pa.binary())], schema=_SENT)

    def compare(key, blobs: pa.Table, sent: pa.Table) -> pa.Table:
        others: dict[int, list[int]] = {}
        sets: dict[int, np.ndarray] = {}
        for a, b, raw in zip(sent["a"].to_pylist(), sent["b"].to_pylist(), sent["own"].to_pylist(), strict=True):
            if raw is None:
                others.setdefault(b, []).append(a)
            else:
                sets[a] = np.frombuffer(raw, np.uint64)
        found = _Forest()
        for sid, own in _sets(blobs["blob"], np.array(list(others), np.int64), width):
            for a in others[sid]:
                if not found.joined(a, sid) and _similar(own, sets[a], similarity):
                    found.join(a, sid)
        return found.table()

    sets = texts.groupBy("part").cogroup(X.dealt(asked, parts, "part").groupBy("part")).applyInArrow(lambda k, t, a: send(k, t, a), "part int, a long, b long, own binary")
    mixed = sets.unionByName(pairs.select(_part("b", parts).alias("part"), "a", "b", F.lit(None).cast("binary").alias("own")))
    return texts.groupBy("part").cogroup(X.dealt(mixed, parts, "part").groupBy("part")).applyInArrow(lambda k, t, s: compare(k, t, s), "a long, b long")


_SENT = pa.schema({"part": pa.int32(), "a": pa.int64(), "b": pa.int64(), "own": pa.binary()})


def _text_parts(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows (part, blob): sealed (sid, text) of the documents, by part of their set's hash."""

    def emit(batches):
        for block in T.blocks(batches, "text", BLOCK):
            sid = set_ids(*shingle_sets(block.column("text"), width))
            ids, rows = np.unique(sid, return_index=True)  # copies once
            rows = rows[ids != 0]
            table = pa.table({"sid": sid[rows], "text": block.column("text").cast(pa.large_string()).take(pa.array(rows))})
            for part, own in X.grouped((sid[rows] % parts).astype(np.int32)):
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "blob": pa.array([X.seal(table.take(pa.array(own)).combine_chunks())], pa.binary())})

    return docs.select("text").mapInArrow(emit, "part int, blob binary")


def _candidate_texts(texts: DataFrame, ids: DataFrame, parts: int) -> DataFrame:
    """The sealed texts of these sids only, each once."""

    def pick(key, blobs: pa.Table, ids: pa.Table) -> pa.Table:
        wanted, out = np.sort(ids["sid"].to_numpy()), []
        done = np.zeros(len(wanted), bool)
        for blob in blobs["blob"] if len(wanted) else []:
            table = X.unseal(blob.as_py())
            sid = table["sid"].to_numpy()
            at = np.minimum(np.searchsorted(wanted, sid), len(wanted) - 1)
            keep = (wanted[at] == sid) & ~done[at]
            done[at[keep]] = True
            if keep.any():
                out.append(X.seal(table.filter(pa.array(keep)).combine_chunks()))
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["part", "blob"])

    texts = X.dealt(texts, parts, "part")
    return texts.groupBy("part").cogroup(X.dealt(ids.withColumn("part", _part("sid", parts)), parts, "part").groupBy("part")).applyInArrow(lambda k, t, i: pick(k, t, i), "part int, blob binary")


class _Bucket:
    """A bucket's groups, and what is known of their members."""

    def __init__(self, groups: pa.Table, named: pa.Table):
        sid = named["sid"].to_numpy()
        order = np.argsort(sid)
        self.sid, self.n = sid[order], named["n"].to_numpy()[order]
        self.component, self.weight = named["component"].to_numpy()[order], named["weight"].to_numpy()[order]
        self.sketch = np.frombuffer(b"".join(named["sketch"].to_pylist()), np.uint8).reshape(len(sid), -1)[order]
        self.groups = groups

    def mixed(self) -> Iterator[np.ndarray]:
        """Members of each group with more than one component."""
        for ids, sizes, members in zip(self.groups["ids"], self.groups["sizes"], self.groups["members"], strict=True):
            own = np.searchsorted(self.sid, np.asarray(ids.values))
            size = X.unseal(sizes.as_py())["n"].to_numpy().astype(np.int64)
            at = own[X.unseal(members.as_py())["at"].to_numpy()]
            begin = np.r_[0, np.cumsum(size)[:-1]]
            component = self.component[at]
            for g in np.flatnonzero(np.minimum.reduceat(component, begin) != np.maximum.reduceat(component, begin)):
                yield at[begin[g] : begin[g] + size[g]]

    def allows(self, x, y: np.ndarray, similarity: int) -> np.ndarray:
        """Those of y that sizes and sketches allow to be similar to x, in another component."""
        n = self.n[y]
        y = y[(self.component[y] != self.component[x]) & (100 * np.minimum(n, self.n[x]) >= similarity * np.maximum(n, self.n[x]))]
        return y[sketch_allows(self.sketch[y], self.sketch[x][None])] if len(y) else y


def _consensus(sketch: np.ndarray) -> np.ndarray:
    """The most frequent 2-bit values of the members, packed like a sketch."""
    out = np.zeros(sketch.shape[1], np.uint8)
    for shift in (0, 2, 4, 6):
        two = (sketch >> shift) & 3
        out |= (np.stack([(two == v).sum(0) for v in range(4)]).argmax(0).astype(np.uint8) << shift).astype(np.uint8)
    return out


def _anchored(found: DataFrame, named: DataFrame, similarity: int, random: bool) -> DataFrame:
    """Distinct pairs (a, b) of members of mixed groups with the group's anchor nearest to their consensus, and with a random one."""

    def pair(key, groups: pa.Table, named: pa.Table) -> pa.Table:
        b = _Bucket(groups, named)
        salt = T.mix(b.sid.view(np.uint64) + np.uint64(key[0].as_py()))
        met: list[list[tuple]] = [[], []]
        for rows in b.mixed():
            anchors = [int(rows[_POP[b.sketch[rows] ^ _consensus(b.sketch[rows])].sum(1).argmax()] if len(rows) > 2 else rows[0])]
            anchors += [int(rows[np.argmin(salt[rows])])] if random else []
            for k, a in enumerate(anchors):
                y = b.allows(a, rows, similarity)
                if len(y):
                    met[k].append((y, np.full(len(y), a), _POP[b.sketch[y] ^ b.sketch[a][None]].sum(1)))
        out = []
        for found in met:  # of a member's anchors the nearest: a member has a pair of either kind at most
            if found:
                y, a, near = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((-near, y))
                order = order[np.r_[True, y[order[1:]] != y[order[:-1]]]]
                x, z = b.sid[y[order]], b.sid[a[order]]
                out.append(np.stack([np.minimum(x, z), np.maximum(x, z)], 1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table([pairs[:, 0], pairs[:, 1]], names=["a", "b"])

    return found.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(lambda k, g, n: pair(k, g, n), "a long, b long").distinct()


def _known(sid, n, sketch, component) -> bytes:
    return X.seal(pa.table({"sid": sid, "n": n, "component": component, "sketch": pa.array([x.tobytes() for x in sketch], pa.binary())}))


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ASKED)], schema=_ASKED)


def _remaining(found: DataFrame, named: DataFrame, texts: DataFrame, parts: int, width: int, similarity: int) -> DataFrame:
    """Links (a, b) between components (by their least sets) that have linked sets in one group: a spanning forest in each part."""

    def ask(key, groups: pa.Table, named: pa.Table) -> pa.Table:
        b, asked, others = _Bucket(groups, named), [], []
        place = np.empty(len(b.sid), np.int64)
        place[np.lexsort((b.component, b.weight))] = np.arange(len(b.sid))  # from the smallest component on
        for rows in b.mixed():
            rows = rows[np.argsort(b.n[rows], kind="stable")]
            n = b.n[rows]
            most = b.component[rows[place[rows].argmax()]]
            for x in rows[b.component[rows] != most]:
                low, high = np.searchsorted(n, [-(-b.n[x] * similarity // 100), b.n[x] * 100 // similarity + 1])
                y = rows[low:high]
                y = b.allows(x, y[place[y] > place[x]], similarity)
                if len(y):
                    to = np.unique(b.sid[y] % parts)
                    asked.append(np.stack([np.full(len(to), x), to], 1))
                    others.append(y)
        asked = np.unique(np.concatenate(asked), axis=0) if asked else np.zeros((0, 2), np.int64)
        others = np.unique(np.concatenate(others)) if others else np.zeros(0, np.int64)
        rows = []
        for part, which in X.grouped((b.sid[asked[:, 0]] % parts).astype(np.int32)):
            x, to = asked[which].T
            rows.append((int(part), X.seal(pa.table({"to": to.astype(np.int32)})), _known(b.sid[x], b.n[x], b.sketch[x], b.component[x]), None))
        for part, which in X.grouped((b.sid[others] % parts).astype(np.int32)):
            y = others[which]
            rows.append((int(part), None, _known(b.sid[y], b.n[y], b.sketch[y], b.component[y]), None))
        return _rows(rows)

    def send(key, blobs: pa.Table, asked: pa.Table) -> pa.Table:
        targets: dict[int, set[int]] = {}
        known: dict[int, bytes] = {}
        for to, blob in zip(asked["to"], asked["known"], strict=True):
            table = X.unseal(blob.as_py())
            for k, (sid, part) in enumerate(zip(table["sid"].to_pylist(), X.unseal(to.as_py())["to"].to_pylist(), strict=True)):
                targets.setdefault(sid, set()).add(part)
                if sid not in known:
                    known[sid] = X.seal(table.slice(k, 1).combine_chunks())
        sets = _sets(blobs["blob"], np.array(list(targets), np.int64), width)
        return _rows([(to, None, known[sid], own.tobytes()) for sid, own in sets for to in targets[sid]])

    def compare(key, blobs: pa.Table, sent: pa.Table) -> pa.Table:
        local = [X.unseal(k.as_py()) for k, own in zip(sent["known"], sent["own"], strict=True) if not own.is_valid]
        found = _Forest()
        if local:
            local = pa.concat_tables(local)
            sid, first = np.unique(local["sid"].to_numpy(), return_index=True)
            local = local.take(pa.array(first))
            n, component = local["n"].to_numpy(), local["component"].to_numpy()
            sketch = np.frombuffer(b"".join(local["sketch"].to_pylist()), np.uint8).reshape(len(sid), -1)
            sets = dict(_sets(blobs["blob"], sid, width))
        for known, own in zip(sent["known"], sent["own"], strict=True):
            if not own.is_valid or not local:
                continue
            x, own = X.unseal(known.as_py()).to_pylist()[0], np.frombuffer(own.as_py(), np.uint64)
            y = np.flatnonzero((component != x["component"]) & (100 * np.minimum(n, x["n"]) >= similarity * np.maximum(n, x["n"])))
            y = y[sketch_allows(sketch[y], np.frombuffer(x["sketch"], np.uint8)[None])]
            for k in y.tolist():
                if not found.joined(x["component"], int(component[k])) and _similar(own, sets[int(sid[k])], similarity):
                    found.join(x["component"], int(component[k]))
        return found.table()

    schema = "part int, to binary, known binary, own binary"
    texts = X.dealt(texts, parts, "part")
    asked = X.cut(found.groupBy("bucket").cogroup(named.groupBy("bucket")).applyInArrow(lambda k, g, n: ask(k, g, n), schema).coalesce(parts))
    sets = texts.groupBy("part").cogroup(X.dealt(asked.where("to is not null"), parts, "part").groupBy("part")).applyInArrow(lambda k, t, a: send(k, t, a), schema)
    mixed = sets.unionByName(asked.where("to is null"))
    return texts.groupBy("part").cogroup(X.dealt(mixed, parts, "part").groupBy("part")).applyInArrow(lambda k, t, m: compare(k, t, m), "a long, b long")


_ASKED = pa.schema({"part": pa.int32(), "to": pa.binary(), "known": pa.binary(), "own": pa.binary()})


def near_duplicates(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """Groups documents by links of at least `similarity` percent Jaccard similarity of their sets of `width`-word shingles.

    docs: doc_id, text; other columns don't matter. Returns doc_id, tag (hash of the text), n_shingles, component_id (the
    smallest doc_id that is reachable over links, itself included) and kept (whether it is its own). A null text, or one
    without words, has an empty set and is linked with nothing; one of fewer words than a shingle has its whole sequence as
    its only element. Rows that share a doc_id are judged each by its own text. A null doc_id is never a component_id unless
    its whole group has none, and is then kept. An empty table gives no rows.
    """
    parts = X.parts_for(docs)
    scanned = X.cut(_scan(docs, width))
    some = scanned.where("sid is not null")
    info = X.cut(some.dropDuplicates(["sid"]).select("sid", "n", "small", "sketch").coalesce(parts))
    spread = max(1, -(-info.count() * SUB // BUCKET_KEYS))
    found = X.cut(_buckets(info.select("sid", "small"), spread).coalesce(SUB * spread))
    spots = found.select("bucket", F.explode("ids").alias("sid")).join(info.select("sid", "n", "sketch"), "sid")
    spots = X.cut(spots.select(F.col("bucket").alias("bucket"), "sid", "n", "sketch").coalesce(SUB * spread))
    texts = X.cut(_candidate_texts(_text_parts(docs, width, parts), spots.select("sid").distinct(), parts).coalesce(parts))
    links, labels = None, None
    for step in range(3):
        if labels is None:
            named = spots.select("*", F.col("sid").alias("component"), F.lit(1).cast("long").alias("weight"))
        else:
            # a table of its own: a join that doesn't share its shuffle with the aggregate can deal a large component anew
            sized = labels.join(X.cut(labels.groupBy("component").agg(F.count("*").alias("weight"))), "component")
            named = spots.join(sized, spots.sid == sized.node, "left").select("bucket", "sid", "n", "sketch", F.coalesce("component", "sid").alias("component"), F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
        more = _confirm(_anchored(found, named, similarity, step > 0), texts, parts, width, similarity) if step < 2 else _remaining(found, named, texts, parts, width, similarity)
        more = X.cut(more.coalesce(parts))
        if labels is None or not more.isEmpty():
            links = more if links is None else links.unionByName(more)
            labels = X.cut(components(links))
    least = some.groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = X.cut(least.join(labels, least.sid == labels.node, "left").select("sid", "least", F.coalesce("component", "sid").alias("component")))
    final = named.join(X.cut(named.groupBy("component").agg(F.min("least").alias("component_id"))), "component").select("sid", "component_id")
    out = scanned.select("doc_id", "tag", "n", "sid").join(final, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, similarity: int = 80) -> DataFrame:
    """The documents, with all their columns, without those that another of their group stands for."""
    gone = near_duplicates(docs, width, similarity).where("not kept").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    return docs.join(gone, docs.doc_id.cast("long").eqNullSafe(gone["__id"]) & (F.xxhash64(docs.text) == gone["__tag"]), "left_anti")
