"""Line dedup: lines that occurred earlier, but for at most one edit, go.

Equal lines are found by hash. Lines one edit apart (a code point inserted, deleted or replaced)
are found by a deletion neighbourhood, coarse to fine. First a line emits the variants in which a
quarter of it is deleted, as hashed keys; lines that share no such key can't be one edit apart.
Those that do emit the variants in which one code point of that quarter is deleted, and equal
variants are joined. Two lines of one length with equal variants at one position differ by a
replacement; a line that equals a variant of a longer one differs by an insertion: with its length
and position in the key, equality of the 128-bit key verifies the distance.

Lines travel as hashes, and each distinct line once; a line of a third of all documents is
combined before the shuffle. Texts are dealt to parts as compressed blocks, to emit the variants
of candidates and to drop lines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import exchange as X
from . import text as T

#: Code points of the shortest line that is judged at all, and of the shortest that may differ by an edit: below, most lines
#: one edit apart are different words (figures in the README).
LEAST, LEAST_NEAR = 1, 10
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
_I1, _I2 = np.uint64(pow(int(_P1), -1, 1 << 64)), np.uint64(pow(int(_P2), -1, 1 << 64))
_POINTS = T.mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x1234567))
_NONE = -(1 << 63)


class Lines:
    """The judged lines of a column of texts, stripped of white space, on code points; with prefix sums for hashes."""

    def __init__(self, column, least: int):
        data, at = T.flat(column)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        at = lead[at]
        n = len(points)
        small = points < 128
        space = small & T.SPACE[np.where(small, points, 0)]
        newline = np.flatnonzero(points == 10)
        starts = np.unique(np.r_[at[:-1], newline + 1])
        starts = starts[starts < n]
        doc = np.searchsorted(at, starts, "right") - 1
        after = np.searchsorted(newline, starts)
        ends = np.minimum(at[doc + 1], np.r_[newline, n][after]) if len(starts) else starts
        # a line's number in its text: newlines of the text before it
        number = after - np.searchsorted(newline, at[doc])
        solid = np.flatnonzero(~space)
        a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = b > a
        begin, end = solid[a[some]], solid[b[some] - 1] + 1
        keep = end - begin >= least
        self.begin, self.end = begin[keep], end[keep]
        self.doc, self.number = doc[some][keep], number[some][keep].astype(np.int32)
        self.length = self.end - self.begin
        value = _POINTS[points & 0xFFFF]
        high = points >= 1 << 16
        if high.any():
            value = np.where(high, T.mix(points.astype(np.uint64) + np.uint64(0x1234567)), value)
        self.sums = [np.zeros(n + 1, np.uint64) for _ in range(2)]
        self.base = [T.powers(p, n + 1) for p in (_P1, _P2)]
        self.back = [T.powers(p, n + 1) for p in (_I1, _I2)]
        for s, p in zip(self.sums, self.base, strict=True):
            np.cumsum(value * p[:n], out=s[1:])

    def raw(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The polynomial of the code points from a to b, not mixed."""
        return (self.sums[k][b] - self.sums[k][a]) * self.back[k][a]

    def without(self, k: int, begin: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The polynomial of a line without its code points from a to b."""
        return self.raw(k, begin, a) + self.raw(k, b, end) * self.base[k][a - begin]

    def hashes(self, k: int) -> np.ndarray:
        return T.mix(self.raw(k, self.begin, self.end) + self.length.astype(np.uint64)).view(np.int64)


def _quarter(n: np.ndarray, j: int) -> np.ndarray:
    return n * j // 4


def coarse_keys(lines: Lines, which: np.ndarray) -> np.ndarray:
    """lines x 8 keys: without each quarter, as a line of its own length and as one of a code point more than its match."""
    begin, end, length = lines.begin[which], lines.end[which], lines.length[which]
    out = np.empty((len(which), 8), np.uint64)
    for longer in (0, 1):
        n = length - longer
        for j in range(4):
            a, b = begin + _quarter(n, j), end - (n - _quarter(n, j + 1))
            h = lines.without(0, begin, a, b, end) + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(j)
            out[:, 4 * longer + j] = T.mix(h)
    return out


def _blocks(docs: DataFrame, least: int, least_near: int):
    """The scan: for each distinct line of a block its hashes and first position, and its coarse keys."""

    def emit(batches):
        for block in T.blocks(batches, "text", 1 << 20):
            lines = Lines(block.column("text"), least)
            if not len(lines.begin):
                continue
            ids, tags = X.ids_of(block.column("doc_id")), np.asarray(block.column("tag"))
            h1, h2 = lines.hashes(0), lines.hashes(1)
            order = np.lexsort((lines.number, tags[lines.doc], ids[lines.doc], h1))
            order = order[np.r_[True, h1[order[1:]] != h1[order[:-1]]]]
            near = lines.length[order] >= least_near
            keys = np.zeros((len(order), 8), np.uint64)
            keys[near] = coarse_keys(lines, order[near])
            flat, at = keys.reshape(-1).view(np.uint8), np.r_[0, np.cumsum(np.where(near, 64, 0))]
            flat = keys[near].reshape(-1).view(np.uint8) if len(flat) else flat
            yield pa.record_batch({
                "h1": pa.array(h1[order]), "h2": pa.array(h2[order]), "doc_id": pa.array(ids[lines.doc[order]]), "tag": pa.array(tags[lines.doc[order]]),
                "line": pa.array(lines.number[order], pa.int32()), "keys": T.binaries(None, flat, at),
            })

    return docs.select("doc_id", "tag", "text").mapInArrow(emit, "h1 long, h2 long, doc_id long, tag long, line int, keys binary")


def _candidates(scan: DataFrame, buckets: int) -> DataFrame:
    """Rows (h1, codes): distinct lines that share a coarse key with another, and which of their keys, as bits."""

    def emit(batches):
        for batch in batches:
            raw = [k for k in batch.column("keys").to_pylist()]
            some = np.array([bool(k) for k in raw])
            if not some.any():
                continue
            h1 = np.asarray(batch.column("h1"))[some]
            keys = np.frombuffer(b"".join(raw), np.uint64)
            bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            for b, which in X.grouped(bucket):
                own = keys[which]
                line = which // 8
                used, at = np.unique(line, return_inverse=True)
                table = pa.table({"line": at.astype(np.uint32), "code": (which % 8).astype(np.uint8)})
                yield pa.record_batch([pa.array([b], pa.int32()), *(pa.array([x], pa.binary()) for x in (own.astype(np.uint32).tobytes(), (own >> np.uint64(32)).astype(np.uint8).tobytes(), X.seal(table), h1[used].tobytes()))], names=["bucket", "low", "high", "of", "lines"])

    def settle(key, table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x.as_py(), kind) for x in table[c]]
        keys = np.concatenate(read("high", np.uint8)).astype(np.uint64) << np.uint64(32) | np.concatenate(read("low", np.uint32))
        of = [X.unseal(x.as_py()) for x in table["of"]]
        h1 = np.concatenate([s[t["line"].to_numpy()] for s, t in zip(read("lines", np.int64), of, strict=True)])
        code = np.concatenate([t["code"].to_numpy() for t in of])
        order = np.lexsort((h1, keys))
        keys, h1, code = keys[order], h1[order], code[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[begin, len(keys)])
        many = np.repeat(h1[begin] != h1[begin + size - 1], size)
        pairs = np.unique(np.stack([h1[many], code[many].astype(np.int64)], 1), axis=0)
        return pa.table([pairs[:, 0], (1 << pairs[:, 1]).astype(np.int32)], names=["h1", "codes"])

    sent = scan.select("h1", "keys").mapInArrow(emit, "bucket int, low binary, high binary, of binary, lines binary")
    return X.dealt(sent, buckets, "bucket").groupBy("bucket").applyInArrow(lambda k, t: settle(k, t), "h1 long, codes int").groupBy("h1").agg(F.bit_or("codes").alias("codes"))


#: A variant: key, whether a whole line (0) or a variant of a longer one (1) or of an equally long one (2), and where the line begins.
_VARIANT = "k1 long, k2 long, role int, doc_id long, tag long, line int"
_VARIANTS = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in _VARIANT.split(", ")])


def _variants(lines: Lines, which: np.ndarray, codes: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """(line, k1, k2, role) of the candidates' variants."""
    out = []
    whole = which[(codes & 15) > 0]
    out.append((whole, lines.hashes(0)[whole], lines.hashes(1)[whole], np.zeros(len(whole), np.int32)))
    for longer in (0, 1):
        for j in range(4):
            own = which[(codes >> (4 * longer + j)) & 1 > 0]
            n = lines.length[own] - longer
            low, high = _quarter(n, j), _quarter(n, j + 1) + longer
            count = high - low
            line = np.repeat(own, count)
            i = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            begin, end = lines.begin[line], lines.end[line]
            k = []
            for h in (0, 1):
                v = lines.without(h, begin, begin + i, begin + i + 1, end) + (lines.length[line] - 1).astype(np.uint64)
                if not longer:  # a replacement: at one position, of lines of one length
                    v = v + T.mix(i.astype(np.uint64) + np.uint64(17)) + np.uint64(0x94D049BB133111EB)
                k.append(T.mix(v).view(np.int64))
            out.append((line, *k, np.full(len(line), 1 if longer else 2, np.int32)))
    return out


def _near_removed(texts: DataFrame, lines: DataFrame, candidates: DataFrame, least: int, parts: int) -> DataFrame:
    """Rows (doc_id, tag, line), the first position, of distinct lines of which another, one edit apart, begins earlier.

    Lines meet their candidates by 64 bits of their hash, which may add candidates; what is removed is known by its position.
    """
    wanted = X.dealt(lines.join(candidates, "h1").select("part", "doc_id", "tag", "line", "codes"), parts, "part")

    def emit(key, texts: pa.Table, wanted: pa.Table) -> pa.Table:
        name = T.mix(X.id_hash(wanted["doc_id"]) + wanted["tag"].to_numpy().view(np.uint64))
        order = np.argsort(name)
        name = name[order]
        line_no, codes = wanted["line"].to_numpy()[order], wanted["codes"].to_numpy()[order]
        found, done = [], set()
        for blob in texts["blob"] if len(wanted) else []:
            table = X.unseal(blob.as_py())
            ids, tags = X.ids_of(table["doc_id"]), table["tag"].to_numpy()
            own = T.mix(X.id_hash(table["doc_id"]) + tags.view(np.uint64))
            low, high = np.searchsorted(name, own), np.searchsorted(name, own, "right")
            rows = np.array([r for r in np.flatnonzero(high > low) if not (own[r] in done or done.add(own[r]))], np.int64)
            if not len(rows):
                continue
            # the candidate lines alone, each as a text
            pieces, owner, number, code = [], [], [], []
            for r, text in zip(rows.tolist(), table["text"].take(pa.array(rows)).to_pylist(), strict=True):
                split = text.split("\n")
                for k, c in zip(line_no[low[r] : high[r]].tolist(), codes[low[r] : high[r]].tolist(), strict=True):
                    pieces.append(split[k])
                    owner.append(r)
                    number.append(k)
                    code.append(c)
            owner, number, code = np.array(owner), np.array(number, np.int32), np.array(code, np.int64)
            for i, j in T.slices(np.r_[0, np.cumsum([len(x) for x in pieces])], 1 << 20):
                lines = Lines(pa.array(pieces[i:j], pa.string()), least)
                for line, k1, k2, role in _variants(lines, np.arange(len(lines.begin)), code[i + lines.doc]):
                    at = i + lines.doc[line]
                    r = owner[at]
                    found.append(pa.record_batch([pa.array(x, f.type) for x, f in zip((k1, k2, role, ids[r], tags[r], number[at]), _VARIANTS, strict=True)], schema=_VARIANTS))
        return pa.Table.from_batches(found, _VARIANTS)

    made = X.cut(texts.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(lambda k, t, w: emit(k, t, w), _VARIANT))
    made = made.withColumn("at", F.struct("doc_id", "tag", "line"))
    first = made.groupBy("k1", "k2").agg(F.count("*").alias("n"), *(F.min(F.when(F.col("role") == r, F.col("at"))).alias(f"at{r}") for r in range(3))).where("n > 1").drop("n")
    met = made.join(first, ["k1", "k2"])
    earlier = F.when(F.col("role") == 0, F.col("at1")).when(F.col("role") == 1, F.col("at0")).otherwise(F.col("at2"))
    return met.where(earlier < F.col("at")).select("doc_id", "tag", "line").distinct()


def dedup_lines(docs: DataFrame, least: int = LEAST, parts: int | None = None, least_near: int = LEAST_NEAR) -> DataFrame:
    """The documents with all their columns, text without repeated lines, and n_lines, n_removed, n_blank_left.

    A line is a piece between newlines, judged without white space at its ends if that leaves `least` code points or more (all
    but blank lines). It goes if an earlier line, at a smaller doc_id or earlier in the text, equals it or, both having
    `least_near` code points or more, is one edit apart; lines are judged on the input, not on what is left. Other lines stay as they are, in place. If
    n_chars is a column it is the new text's length. A null text stays null, with no lines. A null doc_id comes first. Rows
    that share a doc_id come in the order of a hash of their texts; rows that also share the text are one document and lose the
    same lines. An empty table gives no rows. Columns named n_lines, n_removed or n_left are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_left")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc_id"), F.xxhash64("text").alias("tag"), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    parts = parts or X.parts_for(docs)
    scan = X.cut(_blocks(own, least, least_near))
    spread = F.pmod(F.xxhash64("at.doc_id", "at.tag"), F.lit(parts)).cast("int")
    by_hash = scan.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "tag", "line")).alias("at"))
    lines = X.cut(by_hash.select(spread.alias("part"), "at.*", "h1"))
    candidates = X.cut(_candidates(scan, max(1, parts // 4)))
    del scan, by_hash
    texts = X.dealt(_row_parts(own, parts), parts, "part")
    gone = X.cut(_near_removed(texts, lines, candidates, least, parts))
    kept = X.dealt(lines.join(gone, ["doc_id", "tag", "line"], "left_anti").select("part", "doc_id", "tag", "line"), parts, "part")
    result = _arrow(docs.schema)

    def finish(key, texts: pa.Table, kept: pa.Table) -> pa.Table:
        name = T.mix(X.id_hash(kept["doc_id"]) + kept["tag"].to_numpy().view(np.uint64))
        order = np.argsort(name)
        name, line_no = name[order], kept["line"].to_numpy()[order]
        out = []
        for blob in texts["blob"]:
            table = X.unseal(blob.as_py())
            own = T.mix(X.id_hash(table["doc_id"]) + table["tag"].to_numpy().view(np.uint64))
            low, high = np.searchsorted(name, own), np.searchsorted(name, own, "right")
            made, n, removed, left = [], [], [], []
            for text, i, j in zip(table["text"].to_pylist(), low, high, strict=True):
                stay = set(line_no[i:j].tolist())
                pieces = (text or "").split("\n")
                judged = [len(p.strip(" \t\n\x0b\f\r")) >= least for p in pieces]
                rest = [p for k, p in enumerate(pieces) if not judged[k] or k in stay]
                made.append(None if text is None else "\n".join(rest))
                n.append(sum(bool(p.strip(" \t\n\x0b\f\r")) for p in pieces))
                removed.append(len(pieces) - len(rest))
                left.append(n[-1] - removed[-1])
            rows = table["row"].combine_chunks()
            columns = {f.name: rows.field(k) if not isinstance(rows, pa.ChunkedArray) else None for k, f in enumerate(rows.type)}
            columns["text"] = pa.array(made, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if m is None else len(m) for m in made], columns["n_chars"].type)
            out.append(pa.table(columns | {"n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_left": pa.array(left, pa.int64())}))
        return pa.concat_tables(out) if out else pa.Table.from_batches([], schema=result)

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_removed long, n_left long"
    return texts.groupBy("part").cogroup(kept.groupBy("part")).applyInArrow(lambda k, t, r: finish(k, t, r), schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    for name in ("n_lines", "n_removed", "n_left"):
        out = out.append(pa.field(name, pa.int64()))
    return out


def _row_parts(own: DataFrame, parts: int) -> DataFrame:
    """Rows (part, blob): sealed tables of doc_id, tag, text and the whole row without its text, by doc_id and text.

    Empty texts, which have no lines, are dealt out in turn.
    """

    def emit(batches):
        for block in T.blocks(batches, "text", 4 << 20):
            table = pa.Table.from_batches([block])
            for part, rows in X.grouped(np.asarray(block.column("part"))):
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "blob": pa.array([X.seal(table.take(pa.array(rows)).drop_columns(["part"]).combine_chunks())], pa.binary())})

    slim = F.col("row").withField("text", F.lit(None).cast("string"))
    spot = F.when(F.octet_length("text") > 0, F.xxhash64("doc_id", "tag")).otherwise(F.monotonically_increasing_id())
    named = own.select(F.pmod(spot, F.lit(parts)).cast("int").alias("part"), "doc_id", "tag", "text", slim.alias("row"))
    return named.mapInArrow(emit, "part int, blob binary")


def digests(deduped: DataFrame) -> DataFrame:
    """Rows doc_id, n_lines, n_removed, text_sha256 (of the text that is left; of the empty one for null)."""
    return deduped.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def drop_emptied(deduped: DataFrame, columns: list[str]) -> DataFrame:
    """The documents without those that had lines and lost them all."""
    return deduped.where("n_removed = 0 or n_left > 0").select(*(F.col(f"`{c}`") for c in columns))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
