"""Quality rules: robust multivariate outliers of documents' statistics, per language and source.

A document's five statistics are transformed, fixed to 1/256ths (so that sums don't depend on their order) and held
against its group's minimum-covariance-determinant estimate by Mahalanobis distance. The estimate comes from
concentration steps over all rows: a step bins each group's distances, keeps the bins that hold its nearest `share`
of rows (the last bin whole, which is 1.6 % wide) and takes their mean and covariance. Several starts take two steps
each, the one of the least determinant goes on until that no longer falls. Each step is one grouped sum; only small
matrices, one a group and start, meet Python.

Small groups say little of themselves: a group is judged by the mean and covariance of a mixture of itself and its language, and a
language by one of itself and all rows. A group's weight grows with its rows, n / (n + PRIOR_ROWS); there is no size at which
it begins to be judged by itself.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, materialize, running_offsets, slices, whole_text

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMENSIONS = 5
UNIT = 256
#: Least standard deviations, so that a statistic that hardly varies in a group (no symbols at all, say) rejects no
#: document for a small difference.
FLOORS = (0.35, 0.10, 0.50, 0.10, 0.10)
#: Covariance of the nearest 75 % of a normal sample in five dimensions, times this, is that of all.
CONSISTENCY = 1.41
#: Starts of the concentration steps: the medians and quartile spreads, and this many means and covariances of about
#: START_ROWS rows each, chosen by a hash of their statistics.
RANDOM_STARTS, START_ROWS = 2, 16
#: Steps that all starts take, steps that the best one takes at most, and the fall of the logarithm of the determinant
#: at which it has settled.
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 12, 1e-3
#: Distances are binned by this many bins a factor of e.
BINS = 64
#: The share of clean documents, were they normal, that may be rejected: one in 10**9.
TAIL = 1e-9
#: Rows of a group at which its own estimate and its parent's weigh alike. A group of 20 weighs 2 %, so that junk among so few
#: rows doesn't hide behind an estimate of its own.
PRIOR_ROWS = 1_000
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode()
    words = data.split()
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        found, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def _vector() -> list[Column]:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    plain = [F.log1p("n_words"), F.log(chars / n), F.log1p(1000 * F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * UNIT).cast("long").alias(f"z{i}") for i, x in enumerate(plain)]


def document_stats(docs: DataFrame, *keep: Column) -> DataFrame:
    """Columns `keep`, the five statistics, base_failed, lang, source and the vector z0 to z4, for every row of docs."""
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[k.alias(n) for k, n in zip(keep, names, strict=True)], F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), whole_text().alias("_text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def count(batches):
        for b in slices(batches):
            found = list(zip(*[text_stats(x.as_py()) for x in b.column(b.num_columns - 1)], strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, pa.int64()) for c in found)], names=[*b.schema.names[:-1], *STATS])

    counted = rows.mapInArrow(count, kinds + "".join(f", {s} long" for s in STATS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).select("*", *_vector())


def _distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance from array columns: 5 means and 25 numbers of the inverse covariance."""
    d = [F.col(f"z{i}") / UNIT - F.col(mean)[i] for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        for j in range(i, DIMENSIONS):
            total = total + (1 if i == j else 2) * F.col(inverse)[i * DIMENSIONS + j] * d[i] * d[j]
    return total


def chi_square(tail: float, degrees: int = DIMENSIONS) -> float:
    """The value that a chi-square variable exceeds with a probability of `tail`, by bisection."""

    def exceeds(x: float) -> float:
        k, p = (1, math.erfc(math.sqrt(x / 2))) if degrees % 2 else (2, math.exp(-x / 2))
        while k < degrees:
            p, k = p + math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1)), k + 2
        return p

    low, high = 1e-9, 1e4
    while high - low > 1e-9 * high:
        middle = (low + high) / 2
        low, high = (middle, high) if exceeds(middle) > tail else (low, middle)
    return high


def _sums() -> list[Column]:
    """Exact sums of z and of products: a product is under 2**25, so a group may have 2**38 rows."""
    pairs = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    return [F.sum(f"z{i}").alias(f"s{i}") for i in range(DIMENSIONS)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in pairs]


def _estimates(sums: DataFrame) -> DataFrame:
    """One row a group and start: n and the sums of `_sums` -> mean, floored covariance, its inverse and its determinant; `old`, the
    determinant before, is carried."""

    def invert(batches):
        for b in batches:
            table = b.to_pydict()
            means, covs, inverses, dets = [], [], [], []
            for k in range(b.num_rows):
                n = table["n"][k]
                mean = np.array([table[f"s{i}"][k] for i in range(DIMENSIONS)]) / n / UNIT
                cov = np.zeros((DIMENSIONS, DIMENSIONS))
                for i in range(DIMENSIONS):
                    for j in range(i, DIMENSIONS):
                        cov[i, j] = cov[j, i] = table[f"s{i}{j}"][k] / n / UNIT**2 - mean[i] * mean[j]
                # variances below the floor are raised to it, which keeps the matrix positive
                short = np.maximum(0, np.array(FLOORS) ** 2 - CONSISTENCY * np.diag(cov))
                cov = CONSISTENCY * cov + np.diag(short + 1e-9)
                means.append(mean.tolist())
                covs.append(cov.ravel().tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            numbers = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("start"), pa.array(means, numbers), pa.array(covs, numbers), pa.array(inverses, numbers), pa.array(dets, pa.float64()), b.column("old")], names=["grp", "start", "mean", "cov", "inverse", "det", "old"])

    return sums.mapInArrow(invert, "grp string, start int, mean array<double>, cov array<double>, inverse array<double>, det double, old double")


def _inverted(rows: DataFrame) -> DataFrame:
    """grp, mean, cov with inverse."""

    def each(batches):
        for b in batches:
            inverses = [np.linalg.inv(np.array(c).reshape(DIMENSIONS, DIMENSIONS)).ravel().tolist() for c in b.column("cov").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("mean"), pa.array(inverses, pa.list_(pa.float64()))], names=["grp", "mean", "inverse"])

    return rows.select("grp", "mean", "cov").mapInArrow(each, "grp string, mean array<double>, inverse array<double>")


def shrunk(own: Column, parent: Column, rows: Column) -> Column:
    """Between a group's own numbers and its parent's (arrays), by the group's rows."""
    weight = rows / (rows + PRIOR_ROWS)
    return F.zip_with(own, parent, lambda x, y: weight * x + (1 - weight) * y)


def mixed_covariance(own: Column, parent: Column, own_mean: Column, parent_mean: Column, rows: Column) -> Column:
    """The covariance of the mixture: between the two, and as far as the means lie apart."""
    weight = rows / (rows + PRIOR_ROWS)
    apart = lambda i: own_mean[i] - parent_mean[i]
    return F.array(*[weight * own[k] + (1 - weight) * parent[k] + weight * (1 - weight) * apart(k // DIMENSIONS) * apart(k % DIMENSIONS) for k in range(DIMENSIONS * DIMENSIONS)])


def _starts(base: DataFrame) -> DataFrame:
    """First estimates of every group of `base` (grp, n, z0 to z4)."""
    zs = [F.col(f"z{i}") for i in range(DIMENSIONS)]
    quartiles = base.groupBy("grp").agg(*[F.percentile_approx(z, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q{i}") for i, z in enumerate(zs)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT / 1.349, F.lit(FLOORS[i])) for i in range(DIMENSIONS)]
    medians = quartiles.select("grp", F.lit(0).alias("start"), F.array(*[F.col(f"q{i}")[1] / UNIT for i in range(DIMENSIONS)]).alias("mean"), F.array(*[1 / (spread[i] * spread[i]) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]).alias("inverse"), F.lit(None).cast("double").alias("det"))
    medians = medians.select("grp", "start", "mean", F.lit(None).cast("array<double>").alias("cov"), "inverse", "det", F.lit(None).cast("double").alias("old"))
    drawn = F.filter(F.array(*[F.when(F.pmod(F.xxhash64(*zs, F.lit(k)), F.lit(1 << 30)) * F.col("n") < START_ROWS * (1 << 30), F.lit(k)) for k in range(1, RANDOM_STARTS + 1)]), lambda k: k.isNotNull())
    chosen = base.select("grp", *zs, F.explode(drawn).alias("start")).groupBy("grp", "start").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("old"), *_sums())
    return medians.unionByName(_estimates(chosen))


def _binned(near: DataFrame, *values: Column) -> DataFrame:
    """m and `values` of each group's, start's and bin's rows, and `before`: how many rows lie nearer. At most some thousand
    bins a group."""
    bins = near.withColumn("bin", F.floor(F.log(_distance() + 1e-6) * BINS).cast("int")).groupBy("grp", "start", "bin", "n").agg(F.count(F.lit(1)).alias("m"), *values)
    return running_offsets(bins, ["grp", "start"], ["bin"], "m", "before")


def fit_outliers(stats: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(stats with grp, estimates by grp: mean, inverse, scale). Rows that fail the base rules don't shape the estimates.
    scale brings the median distance of a group that spreads wider than its nearest rows tell to that of a normal sample.

    A group is a language and source. Its own estimate, its language's and all rows' come from the rows of each; means,
    covariances and the scale's logarithm are mixed from level to level. An empty table has no estimates.
    """
    fine, coarse, whole = F.concat(F.lit("1"), F.to_json(F.struct("_lang", "_source"), {"ignoreNullFields": "false"})), F.concat(F.lit("2"), F.to_json(F.struct("_lang"), {"ignoreNullFields": "false"})), F.lit("3")
    sizes = stats.where(~F.col("base_failed")).groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(sizes.select("_lang", "_source", fine.alias("grp"), F.array(fine, coarse, whole).alias("levels"), "n"), "quality-groups")
    groups = sizes.count()
    parts = sizes.select("_lang", "_source", "n", F.explode("levels").alias("grp"))
    large = parts.groupBy("grp").agg(F.sum("n").alias("n"))

    def in_groups(rows: DataFrame, named: DataFrame, how: str) -> DataFrame:
        same = rows["_lang"].eqNullSafe(named["_lang"]) & rows["_source"].eqNullSafe(named["_source"])
        return join_small(rows, named, same, how, groups).drop(named["_lang"], named["_source"])

    known = in_groups(stats, sizes.select("_lang", "_source", "grp"), "left")
    base = in_groups(stats.where(~F.col("base_failed")), parts.select("_lang", "_source", "grp"), "inner")
    base = join_small(base, large, "grp", "inner", groups)

    base = materialize(base.select("grp", "n", *[f"z{i}" for i in range(DIMENSIONS)]), "quality-base")

    def step(estimates: DataFrame) -> DataFrame:
        near = join_small(base, estimates, "grp", "inner", groups * (1 + RANDOM_STARTS))
        kept = _binned(near, F.first("det").alias("old"), *_sums()).where(F.col("before") < F.ceil(F.col("n") * share))
        names = [f"s{i}" for i in range(DIMENSIONS)] + [f"s{i}{j}" for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
        return materialize(_estimates(kept.groupBy("grp", "start").agg(F.sum("m").alias("n"), F.first("old").alias("old"), *[F.sum(x).alias(x) for x in names])), "quality-step")

    estimates = materialize(_starts(base), "quality-starts")
    for _ in range(FIRST_STEPS):
        estimates = step(estimates)
    best = estimates.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "cov", "inverse", "det"), F.struct("det", "start")).alias("best"))
    estimates = best.select("grp", "best.*")
    for _ in range(MOST_STEPS):
        estimates = step(estimates)
        if estimates.where(F.abs(F.col("det") - F.col("old")) > SETTLED).isEmpty():
            break

    def by_level(rows: DataFrame, values: list[str]) -> DataFrame:
        """The groups (grp, n of each level as n0 to n2), with `values` of `rows` (grp) at each level."""
        rows = materialize(rows.join(large, "grp").select(F.col("grp").alias("level"), "n", *values), "quality-levels")
        at = join_small(sizes.select("grp", F.posexplode("levels").alias("k", "level")), rows, "level", "inner", groups)
        out = at.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("k", "n", *values))).alias("at")).where(F.size("at") == 3)
        return out.select("grp", *[F.col("at")[k][v].alias(f"{v}{k}") for k in range(3) for v in ("n", *values)])

    middle = _binned(join_small(base, estimates, "grp", "inner", groups)).where(2 * F.col("before") < F.col("n")).groupBy("grp").agg(F.max("bin").alias("bin"))
    spread = middle.select("grp", F.array(F.greatest((F.col("bin") + 0.5) / BINS - F.log(F.lit(chi_square(0.5))), F.lit(0.0))).alias("spread"))
    wide = by_level(estimates.join(spread, "grp"), ["mean", "cov", "spread"])
    for k in (1, 0):  # the language toward all rows, then the group toward the language
        mean, cov, spread, n = (F.col(f"{v}{k}") for v in ("mean", "cov", "spread", "n"))
        up = lambda v: F.col(f"{v}{k + 1}")  # noqa: B023, E731
        wide = wide.withColumns({f"mean{k}": shrunk(mean, up("mean"), n), f"cov{k}": mixed_covariance(cov, up("cov"), mean, up("mean"), n), f"spread{k}": shrunk(spread, up("spread"), n)})
    wide = wide.select("grp", F.col("mean0").alias("mean"), F.col("cov0").alias("cov"), F.exp(F.col("spread0")[0]).alias("scale"))
    wide = materialize(wide, "quality-shrunk")
    return known, materialize(_inverted(wide).join(wide.select("grp", "scale"), "grp").select("grp", "mean", "inverse", "scale"), "quality-estimates")


def judge_quality(docs: DataFrame, *keep: Column, tail: float = TAIL) -> DataFrame:
    """Columns `keep` (as _k0, _k1, ...), the statistics, base_failed, distance (null only where no row of a failed row's
    language and source passes the base rules) and kept of every row.

    A document is kept if it passes the base rules (50 words, at most half of them in repeated windows of three) and
    its squared distance from its group is at most the chi-square quantile that leaves `tail`. Null texts count as empty
    and fail; null languages and sources are groups of their own; repeated rows count each; an empty table gives an empty
    result. Columns of docs other than text, lang, source and those in `keep` are ignored.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    stats = materialize(document_stats(docs, *keep), "quality-stats")
    known, estimates = fit_outliers(stats)
    groups = estimates.count()
    judged = join_small(known, estimates, "grp", "left", groups).withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= chi_square(tail))
    return judged.select(*names, *STATS, "base_failed", "distance", kept.alias("kept"))
