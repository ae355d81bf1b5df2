"""Quality rules: base rules, and robust multivariate outliers by language and source.

A document's statistics become a vector of transformed ratios. For each language and source, each
language, and all rows, the location and scatter of the COVER of rows whose scatter has the least
determinant are sought: from several deterministic starts, concentration steps (distances of all
rows, the nearest share of them, their mean and scatter) go on until the determinant falls no more,
and the least is taken. To a scatter, a floor is added, so it always has an inverse; the
determinant that is minimised is that of the regularised scatter.

A group's estimate is drawn towards its language's, and that towards that of all rows, the more so
the fewer rows it has. Rows beyond a chi-square quantile of the Mahalanobis distance go.

Groups are fitted in blocks of bounded size, so a source with a third of all rows is no task of its
own. Where a group has several blocks, the best of their estimates is concentrated on all rows of the
group, by aggregates that combine before the shuffle, until it converges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T

_LINE = np.zeros(256, bool)
_LINE[0x0A] = True
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_KINDS = {"n_symbols": np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8)), "n_upper": np.zeros(256, bool), "n_digits": np.zeros(256, bool), "n_marks": np.isin(np.arange(256), np.frombuffer(b"!\"'(),-./:;=?@[\\]^_`{}~+", np.uint8))}
_KINDS["n_upper"][0x41:0x5B] = True
_KINDS["n_digits"][0x30:0x3A] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_adjacent", "n_upper", "n_digits", "n_marks"]
#: Share of a group's rows whose scatter is made least.
COVER = 0.75
#: Rows from which a group has an estimate of its own, and rows at which that counts as much as its language's.
LEAST_ROWS, PRIOR_ROWS = 16, 100
#: Rows of a block, about, that is fitted in one task.
BLOCK_ROWS = 8_000
#: Starts from subsets of rows, and how many starts of all are gone on with after two steps.
SUBSETS, FINISHED = 30, 4
#: Added to standard deviations (in quadrature), so that a statistic which hardly varies isn't decisive.
FLOOR = 0.2
#: Rows beyond this quantile of the chi-square distribution are rejected.
QUANTILE = 0.999
#: A fall of the logarithm of a determinant that doesn't count: in a block, and where quantiles are approximate.
SETTLED, SETTLED_ALL = 1e-9, 1e-3
#: Estimates that are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 5_000
DIMENSIONS = ["x_length", "x_symbols", "x_upper", "x_digits", "x_marks", "x_adjacent", "x_lines"]


def _repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each item, how many of the same document equal it, itself included; items are few per document."""
    key = T.mix(h + T.mix(doc.astype(np.uint64) + np.uint64(3)))
    _, number, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[number]


def statistics(column) -> dict[str, np.ndarray]:
    """The counts of every text."""
    data, at = T.flat(column)
    n_docs = len(at) - 1
    starts, ends, first = T.spans(data, at, T.SPACE)
    per = lambda marks: np.diff(np.r_[0, np.cumsum(marks)][at])
    out = {"n_words": np.diff(first), "word_chars": per(((data & 0xC0) != 0x80) & ~T.SPACE[data])}
    out |= {k: per(kind[data]) for k, kind in _KINDS.items()}
    h = np.empty(len(starts), np.uint64)
    lines, line_ends, line_first = T.spans(data, at, _LINE)
    line_hash = np.empty(len(lines), np.uint64)
    for i, j in T.slices(at):
        for hashes, s, e, f in ((h, starts, ends, first), (line_hash, lines, line_ends, line_first)):
            a, b = f[i], f[j]
            hashes[a:b] = T.span_hash(data[at[i] : at[j]], s[a:b] - at[i], e[a:b] - at[i])
    filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, lines)
    doc = np.repeat(np.arange(n_docs), np.diff(line_first))[filled]
    pairs = np.unique(T.mix(line_hash[filled] + T.mix(doc.astype(np.uint64) + np.uint64(3))), return_index=True)[1]
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[pairs], minlength=n_docs)
    word_doc = np.repeat(np.arange(n_docs), np.diff(first))
    out["n_adjacent"] = np.bincount(word_doc[1:][(h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])], minlength=n_docs)
    windows = T.windows(first, 5)
    covered = np.zeros(len(h) + 1, np.int32)
    if len(windows):
        again = windows[_repeats(word_doc[windows], T.rolling(h, 5)[windows]) > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + 5, -1)
    marks = np.r_[0, np.cumsum(np.cumsum(covered[:-1]) > 0)]
    out["n_repeat_words"] = marks[first[1:]] - marks[first[:-1]]
    return out


def measure(docs: DataFrame) -> DataFrame:
    """Rows doc_id, lang, source and the counts of COUNTS, one for each document."""

    def emit(batches):
        for block in T.blocks(batches, "text", 4 << 20):
            found = statistics(block.column("text"))
            yield pa.record_batch([block.column("doc_id"), block.column("lang"), block.column("source"), *(pa.array(found[c], pa.int64()) for c in COUNTS)], names=["doc_id", "lang", "source", *COUNTS])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return own.mapInArrow(emit, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed(least_words: int = 10, most_repeats: int = 20) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def vectors() -> list[Column]:
    """Transformed statistics: logarithms of ratios, drawn towards usual ones where a text is short."""
    n, c = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    share = lambda k, total, least: F.log(F.col(k) / total + F.lit(least))
    return [
        F.log((c + 50) / (n + 10)).alias("x_length"),
        share("n_symbols", c + 500, 0.01).alias("x_symbols"),
        share("n_upper", c + 500, 0.02).alias("x_upper"),
        share("n_digits", c + 500, 0.2).alias("x_digits"),
        share("n_marks", c + 500, 0.02).alias("x_marks"),
        share("n_adjacent", n + 50, 0.02).alias("x_adjacent"),
        share("n_dup_lines", F.col("n_lines").cast("double") + 10, 0.1).alias("x_lines"),
    ]


# Minimum covariance determinant


def chi_share(x: float, degrees: int) -> float:
    """The share of a chi-square distribution up to x, by the series of the incomplete gamma function."""
    a, half = degrees / 2, x / 2
    term = total = math.exp(a * math.log(half) - half - math.lgamma(a + 1)) if half > 0 else 0.0
    k = 0
    while term > 1e-17 * total:
        k += 1
        term *= half / (a + k)
        total += term
    return total


def chi_quantile(share: float, degrees: int) -> float:
    """A quantile of the chi-square distribution, by bisection."""
    low, high = 0.0, 1.0
    while chi_share(high, degrees) < share:
        high *= 2
    for _ in range(80):
        low, high = ((low + high) / 2, high) if chi_share((low + high) / 2, degrees) < share else (low, (low + high) / 2)
    return high


def consistency(cover: float, p: int) -> float:
    """What the scatter of the inner share of normal rows has to be multiplied by to be that of all."""
    return cover / chi_share(chi_quantile(cover, p), p + 2) if cover < 1 else 1.0


def scatter_of(products: np.ndarray, cover: float) -> np.ndarray:
    p = len(products)
    return consistency(cover, p) * products + np.eye(p) * FLOOR**2


def squared(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ij,ij->i", d @ np.linalg.inv(scatter), d)


def starts(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Deterministic starts: medians, with median deviations alone, and with correlations of bounded, ranked and centred rows;
    then SUBSETS of one row more than there are statistics."""
    middle = np.median(x, 0)
    spread = np.sqrt((1.4826 * np.median(np.abs(x - middle), 0)) ** 2 + FLOOR**2)
    yield middle, np.diag(spread**2)
    z = (x - middle) / spread
    ranks = np.argsort(np.argsort(x, 0, kind="stable"), 0, kind="stable").astype(float)
    for y in (np.tanh(z), ranks, z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)):
        with np.errstate(all="ignore"):
            r = np.atleast_2d(np.nan_to_num(np.corrcoef(y.T)))
        np.fill_diagonal(r, 1.0)
        yield middle, (0.9 * r + 0.1 * np.eye(len(r))) * np.outer(spread, spread)
    rng = np.random.default_rng(len(x))
    for _ in range(SUBSETS):
        some = x[rng.integers(0, len(x), x.shape[1] + 1)]
        d = some - some.mean(0)
        yield some.mean(0), d.T @ d / len(some) + np.eye(x.shape[1]) * FLOOR**2


def covered(n: int, p: int, cover: float = COVER) -> int:
    """Rows of which the determinant is made least: that share, but more than half."""
    return min(n, max((n + p + 1) // 2, math.ceil(cover * n)))


def concentrate(x: np.ndarray, mean: np.ndarray, scatter: np.ndarray, h: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Steps to the h rows nearest to their own mean under their own scatter: mean, scatter, log determinant."""
    last = math.inf
    while steps is None or steps > 0:
        near = x[np.argpartition(squared(x, mean, scatter), h - 1)[:h]]
        new = near.mean(0)
        d = near - new
        made = scatter_of(d.T @ d / h, h / len(x))
        det = float(np.linalg.slogdet(made)[1])
        if det >= last - SETTLED:
            break
        mean, scatter, last = new, made, det
        steps = steps and steps - 1
    return mean, scatter, last


def least_determinant(x: np.ndarray, cover: float = COVER) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, scatter and log determinant of the best of all starts: FINISHED of them, the best after two steps, are finished."""
    h = covered(len(x), x.shape[1], cover)
    begun = sorted((concentrate(x, m, s, h, 2) for m, s in starts(x)), key=lambda e: e[2])
    return min((concentrate(x, m, s, h) for m, s, _ in begun[:FINISHED]), key=lambda e: e[2])


_ESTIMATE = "key string, rows long, mean array<double>, scatter array<double>, inverse array<double>, det double"
_ARROW = pa.schema({"key": pa.string(), "rows": pa.int64(), "mean": pa.list_(pa.float64()), "scatter": pa.list_(pa.float64()), "inverse": pa.list_(pa.float64()), "det": pa.float64()})


def _estimate(key: str, rows: int, mean: np.ndarray, scatter: np.ndarray, det: float) -> tuple:
    return key, rows, mean.tolist(), scatter.ravel().tolist(), np.linalg.inv(scatter).ravel().tolist(), det


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _distance() -> Column:
    """Squared Mahalanobis distance of x to mean under the inverse scatter."""
    k = len(DIMENSIONS)
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMENSIONS)]
    return reduce(lambda a, b: a + b, (d[i] * reduce(lambda a, b: a + b, (F.col("inverse")[i * k + j] * d[j] for j in range(k))) for i in range(k)))


def _keys() -> list[Column]:
    """Names of the groups that a row is part of: all, its language, its language and source."""
    name = lambda level, *c: F.concat_ws("\x1f", F.lit(level), *(F.coalesce(F.concat(F.lit("="), F.col(x)), F.lit("null")) for x in c))
    return [F.lit("a"), name("l", "lang"), name("s", "lang", "source")]


def estimates(rows: DataFrame, sizes: DataFrame, small: bool) -> DataFrame:
    """The estimates (_ESTIMATE) of the groups of LEAST_ROWS rows or more.

    rows: key, DIMENSIONS, and spot, a random number from 0 to 1 that is part of the row; sizes: key, n.
    """
    near = F.broadcast if small else (lambda df: df)
    sizes = sizes.where(F.col("n") >= LEAST_ROWS).select(F.col("key").alias("of"), "n", F.ceil(F.col("n") / BLOCK_ROWS).cast("long").alias("blocks"))
    placed = rows.join(near(sizes), rows.key == sizes.of).drop("of").withColumn("block", F.floor(F.col("spot") * F.col("blocks")))

    def fit(key, table: pa.Table) -> pa.Table:
        x = np.stack([table[c].to_numpy() for c in DIMENSIONS], 1)
        return pa.Table.from_batches([_batch([_estimate(key[0].as_py(), table["n"][0].as_py(), *least_determinant(x))], _ARROW)])

    each = placed.select("key", "block", "n", *DIMENSIONS).groupBy("key", "block").applyInArrow(lambda k, t: fit(k, t), _ESTIMATE)
    best = X.cut(each.groupBy("key").agg(F.min_by(F.struct(*(f.name for f in _ARROW)), "det").alias("e")).select("e.*"))
    large = X.cut(placed.where("blocks > 1").select("key", *DIMENSIONS))
    now = X.cut(best.join(near(sizes.where("blocks > 1").select("of")), F.col("key") == F.col("of"), "left_semi"))
    if now.isEmpty():
        return best
    done = best.join(near(now.select(F.col("key").alias("of"))), F.col("key") == F.col("of"), "left_anti")
    # a block's determinant is that of fewer rows: the first step on all rows counts whatever it gives
    moving = X.cut(_step(large, now, near))
    while True:  # a determinant falls in each step, or its group is left as it is
        new = X.cut(_step(large, moving, near))
        fell = new.join(moving.select(F.col("key").alias("of"), F.col("det").alias("last")), F.col("key") == F.col("of")).where(F.col("det") < F.col("last") - SETTLED_ALL)
        better = X.cut(fell.drop("of", "last"))
        if better.isEmpty():
            return X.cut(done.unionByName(moving))
        done = X.cut(done.unionByName(moving.join(better.select(F.col("key").alias("of")), F.col("key") == F.col("of"), "left_anti")))
        moving = better


def _step(rows: DataFrame, now: DataFrame, near) -> DataFrame:
    """One concentration step of all groups, over all their rows."""
    k = len(DIMENSIONS)
    known = now.select("key", "rows", "mean", "inverse")
    far = rows.join(near(known), "key").withColumn("d", _distance())
    cover = far.groupBy("key").agg(F.percentile_approx("d", COVER, 10_000).alias("most"))
    inner = far.join(near(cover), "key").where("d <= most")
    d = [F.col(x) - F.col("mean")[i] for i, x in enumerate(DIMENSIONS)]
    pairs = {(i, j): F.avg(d[i] * d[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)}
    sums = inner.groupBy("key").agg(F.count("*").alias("h"), *(F.avg(d[i]).alias(f"m{i}") for i in range(k)), *pairs.values())
    moments = known.join(sums, "key").select("key", "rows", "h", F.col("mean").alias("shift"), F.array(*(f"m{i}" for i in range(k))).alias("m"), F.array(*(f"p{min(i, j)}_{max(i, j)}" for i in range(k) for j in range(k))).alias("mm"))

    def emit(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m = np.array(r["m"])
                scatter = scatter_of(np.array(r["mm"]).reshape(k, k) - np.outer(m, m), r["h"] / r["rows"])
                out.append(_estimate(r["key"], r["rows"], np.array(r["shift"]) + m, scatter, float(np.linalg.slogdet(scatter)[1])))
            yield _batch(out, _ARROW)

    return moments.mapInArrow(emit, _ESTIMATE)


def mixed(own: tuple[np.ndarray, np.ndarray] | None, n: int, wider: tuple[np.ndarray, np.ndarray] | None):
    """Mean and scatter of a group drawn towards those of a wider one; either may be missing."""
    if own is None or wider is None:
        return own or wider
    w = n / (n + PRIOR_ROWS)
    mean = w * own[0] + (1 - w) * wider[0]
    return mean, sum(v * (s + np.outer(m - mean, m - mean)) for v, (m, s) in ((w, own), (1 - w, wider)))


_JUDGES = pa.schema({"g_lang": pa.string(), "g_source": pa.string(), "mean": pa.list_(pa.float64()), "inverse": pa.list_(pa.float64())})


def _judges(groups: DataFrame, found: DataFrame, near) -> DataFrame:
    """For each language and source the mean and inverse scatter that judge its rows; null where no group has LEAST_ROWS rows."""
    k = len(DIMENSIONS)
    for level in ("all", "by_lang", "own"):
        e = found.select(F.col("key").alias("of"), F.struct("mean", "scatter", "rows").alias(f"e_{level}"))
        groups = groups.join(near(e), F.col(f"k_{level}") == F.col("of"), "left").drop("of")

    def emit(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                now = None
                for level in ("all", "by_lang", "own"):
                    if e := r[f"e_{level}"]:
                        now = mixed((np.array(e["mean"]), np.array(e["scatter"]).reshape(k, k)), e["rows"], now)
                out.append((r["lang"], r["source"], now[0].tolist() if now else None, np.linalg.inv(now[1]).ravel().tolist() if now else None))
            yield _batch(out, _JUDGES)

    return groups.mapInArrow(emit, "g_lang string, g_source string, mean array<double>, inverse array<double>")


def judge(docs: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Rows doc_id, lang, source, the counts of COUNTS, base_failed, distance, and kept: no base rule failed and the squared
    distance is at most that quantile of the chi-square distribution.

    docs: doc_id, text, lang, source; other columns don't matter. A null or empty text has no words and so fails the base
    rules. A null lang or source is a value of its own. Estimates are made from the rows that pass the base rules, repeated
    ones included. Groups of fewer than LEAST_ROWS have no estimate of their own and are judged by their language's, or that of
    all rows; fewer than LEAST_ROWS rows in all reject nothing. An empty table gives no rows. distance is null where the base
    rules failed.
    """
    scored = X.cut(measure(docs).withColumn("base_failed", base_failed()).select("*", *vectors(), F.rand(7).alias("spot")))
    passed = scored.where("not base_failed")
    names = dict(zip(("all", "by_lang", "own"), _keys(), strict=True))
    groups = X.cut(passed.groupBy("lang", "source").agg(F.count("*").alias("n")).select("*", *(c.alias(f"k_{k}") for k, c in names.items())))
    small = groups.count() <= MOST_BROADCAST
    near = F.broadcast if small else (lambda df: df)
    sizes = groups.select(F.explode(F.array(*(f"k_{k}" for k in names))).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    found = estimates(passed.select(F.explode(F.array(*names.values())).alias("key"), "spot", *DIMENSIONS), X.cut(sizes), small)
    judges = X.cut(_judges(groups, found, near))
    met = passed.join(near(judges), passed.lang.eqNullSafe(judges.g_lang) & passed.source.eqNullSafe(judges.g_source))
    far = F.when(F.col("mean").isNull(), 0.0).otherwise(F.sqrt(F.greatest(_distance(), F.lit(0.0))))
    judged = met.select("doc_id", "lang", "source", *COUNTS, "base_failed", far.alias("distance"))
    failed = scored.where("base_failed").select("doc_id", "lang", "source", *COUNTS, "base_failed", F.lit(None).cast("double").alias("distance"))
    cutoff = math.sqrt(chi_quantile(quantile, len(DIMENSIONS)))
    return judged.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))


def rejections(judged: DataFrame) -> DataFrame:
    """Rows lang, source, n, n_failed (base rules) and n_outliers of what `judge` returns."""
    return judged.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("n_failed"), F.count_if(~F.col("base_failed") & ~F.col("kept")).alias("n_outliers"))
