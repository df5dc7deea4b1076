"""Quality rules with robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Statistics of every document are transformed to a vector. For each group of language and source, concentration steps
go out from three starts: medians with quartile spreads, the plain mean and covariance, and those of values clipped
around the medians. A step takes distances from the estimate, the share ``core`` of documents nearest to it, and mean and
covariance of those. After two steps the start of the least covariance determinant goes on, until no group's determinant
falls any more. Documents within the 0.975 quantile of that estimate give the final one. A document goes if its squared
Mahalanobis distance exceeds the chi-square quantile.

Each step is two aggregates with partial sums over all documents, so a group of any size is no single task. The core's
edge comes from counts in fixed bins of the distance's logarithm, a 64th of a doubling wide, so it doesn't depend on how
rows are dealt; the core may be larger than its share by the rows of one bin.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import stash
from .text_stats import counts

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Smallest spread of each transformed statistic, as most groups' cores have no symbols and no repeats at all. For
#: symbols and lines half of what the first one makes (of symbols in 100 characters), for repeated words a quarter of
#: what one repeated window makes in 100 words. The mean length of a few dozen words varies by some hundredths by
#: chance, and a small group's core can be far closer in its number of words than its clean texts are.
FLOOR = (0.6, 0.05, math.log(2) / 2, math.log(2) / 2, 0.08)
DIM = len(FLOOR)


def chi2_cdf(x: float, k: float) -> float:
    """Regularised lower incomplete gamma function of k / 2 at x / 2, by its series."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = 0
    while term > total * 1e-15:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: float) -> float:
    a, b = 0.0, 1000.0
    for _ in range(200):
        m = (a + b) / 2
        a, b = (m, b) if chi2_cdf(m, k) < p else (a, m)
    return (a + b) / 2


def vectors(c: dict[str, np.ndarray]) -> np.ndarray:
    """Transformed statistics: log words, log mean word length, log symbols a hundred, log repeated lines, root share of repeated words."""
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return np.stack([np.log(n), np.log(chars / n), np.log1p(100 * c["n_symbols"] / chars), np.log1p(c["n_dup_lines"]), np.sqrt(c["n_repeat_words"] / n)], 1)


def _stats(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            buf, off = B.column(batch, "text")
            for i, j in B.slices(off):
                c = counts(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                part = batch.slice(i, j - i)
                x = vectors(c)
                failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *(pa.array(c[k].astype(np.int64)) for k in COUNTS), pa.array(failed), *(pa.array(x[:, d].copy()) for d in range(DIM))], [*keep, *COUNTS, "base_failed", *(f"x{d}" for d in range(DIM))])

    return run


def _solve(rows: Iterator[pd.DataFrame], scale: float) -> Iterator[pd.DataFrame]:
    """Precision matrices and log determinants from moments, one row a group and start; spreads below the floor are lifted to it."""
    floor = np.array(FLOOR) ** 2
    for pdf in rows:
        mean, precision, logdet = [], [], []
        for r in pdf.itertuples(index=False):
            m = np.array(r.s) / r.n
            cov = np.zeros((DIM, DIM))
            cov[np.triu_indices(DIM)] = np.array(r.ss) / r.n
            cov = cov + np.triu(cov, 1).T - np.outer(m, m)
            cov *= scale
            cov += np.diag(np.maximum(0, floor - np.diag(cov)))
            w, v = np.linalg.eigh(cov)
            w = np.maximum(w, floor.min() * 0.25)
            mean.append(m.tolist())
            precision.append(((v / w) @ v.T).reshape(-1).tolist())
            logdet.append(float(np.log(w).sum()))
        yield pd.DataFrame({"g": pdf["g"], "start": pdf["start"], "m": mean, "p": precision, "logdet": logdet})


ESTIMATE = "g string, start int, m array<double>, p array<double>, logdet double"


def _moments(rows: DataFrame, scale: float, value=lambda d: F.col(f"x{d}")) -> DataFrame:
    x = [value(d) for d in range(DIM)]
    sums = F.array(*(F.sum(c) for c in x)).alias("s")
    products = F.array(*(F.sum(x[i] * x[j]) for i in range(DIM) for j in range(i, DIM))).alias("ss")
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), sums, products).mapInPandas(lambda it: _solve(it, scale), ESTIMATE)


def covariance_determinant(x: DataFrame, lookup, core: float, most_steps: int = 20) -> DataFrame:
    """(g, start, m, p, logdet): the reweighted minimum-covariance-determinant estimate of every group of (g, x0, x1, ...).

    ``lookup`` may broadcast a table of a few rows a group.
    """
    quartiles = x.groupBy("g").agg(F.count("*").alias("n"), *(F.percentile_approx(f"x{d}", [0.25, 0.5, 0.75], 1000).alias(f"q{d}") for d in range(DIM)))
    spread = [F.greatest((F.element_at(f"q{d}", 3) - F.element_at(f"q{d}", 1)) / 1.349, F.lit(FLOOR[d])) for d in range(DIM)]
    middle = F.array(*(F.element_at(f"q{d}", 2) for d in range(DIM)))
    plain = quartiles.select("g", F.lit(0).alias("start"), middle.alias("m"), F.array(*((1 / (spread[i] * spread[i]) if i == j else F.lit(0.0)) for i in range(DIM) for j in range(DIM))).alias("p"), F.lit(0.0).alias("logdet"), "n", F.array(*spread).alias("spread"))
    plain = stash(plain, "estimate")
    sizes = plain.select("g", F.ceil(F.col("n") * core).alias("least"))
    both = x.join(lookup(plain.select("g", "m", "spread")), "g")
    clipped = lambda d: F.greatest(F.element_at("m", d + 1) - 1.5 * F.element_at("spread", d + 1), F.least(F.element_at("m", d + 1) + 1.5 * F.element_at("spread", d + 1), F.col(f"x{d}")))
    est = plain.select(*[c.split(" ")[0] for c in ESTIMATE.split(", ")])
    est = est.unionByName(_moments(x.withColumn("start", F.lit(1)), 1.0)).unionByName(_moments(both.withColumn("start", F.lit(2)), 1.0, clipped))
    est = stash(est, "estimate")
    scale = core / chi2_cdf(chi2_quantile(core, DIM), DIM + 2)

    def step(est: DataFrame) -> DataFrame:
        d = x.join(lookup(est.select("g", "start", "m", "p")), "g").withColumn("bin", F.floor(F.log2(F.greatest(_distance(), F.lit(0.0)) + 1e-9) * 64).cast("int"))
        upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = d.groupBy("g", "start", "bin").count().withColumn("below", F.sum("count").over(upto)).join(lookup(sizes), "g")
        edge = bins.where("below >= least").groupBy("g", "start").agg(F.min("bin").alias("edge"))
        return stash(_moments(d.join(lookup(edge), ["g", "start"]).where("bin <= edge"), scale), "estimate")

    est = step(step(est))
    est = stash(est.groupBy("g").agg(F.min_by(F.struct("start", "m", "p", "logdet"), F.struct("logdet", "start")).alias("e")).select("g", "e.*"), "estimate")
    for _ in range(most_steps - 2):
        new = step(est)
        fell = new.alias("a").join(est.alias("b"), "g").where("a.logdet < b.logdet - 1e-9")
        if fell.isEmpty():
            break
        # a group whose determinant no longer falls keeps its estimate
        est = stash(new.unionByName(est).groupBy("g").agg(F.min_by(F.struct("start", "m", "p", "logdet"), "logdet").alias("e")).select("g", "e.*"), "estimate")
    near = chi2_quantile(0.975, DIM)
    inside = x.join(lookup(est.select("g", "start", "m", "p")), "g").where(_distance() <= near)
    return stash(_moments(inside, 0.975 / chi2_cdf(near, DIM + 2)), "estimate").join(plain.select("g", "n"), "g")


def _distance():
    z = [F.col(f"x{d}") - F.element_at("m", d + 1) for d in range(DIM)]
    total = F.lit(0.0)
    for i in range(DIM):
        for j in range(i, DIM):
            total = total + F.element_at("p", i * DIM + j + 1) * z[i] * z[j] * (1 if i == j else 2)
    return total


def robust_outliers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", core: float = 0.75, most_steps: int = 20, quantile: float = 0.999, least_group: int = 50, most_broadcast: int = 20_000) -> DataFrame:
    """Per document its counts, base_failed, distance (squared; null if base_failed) and kept.

    Null language or source is a value of its own. Groups of fewer than ``least_group`` documents are judged with the
    others of their language, or of all, that are in such groups; where even those are fewer, nothing is rejected.
    Null and empty texts have no words and fail the base rule. Repeated rows count as often as they stand. Documents
    that fail the base rule take no part in the estimates. Estimates of up to ``most_broadcast`` groups are broadcast
    (a few hundred bytes each), those of more are joined. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, " + ", ".join(f"x{d} double" for d in range(DIM))
    rows = stash(docs.mapInArrow(_stats(["doc_id", "lang", "source"]), schema), "stats")
    # a group's name; small groups join those of their language, then all
    lang = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("-"))
    rows = rows.withColumns({"_l": lang, "_s": source})
    good = rows.where("not base_failed")
    per = good.groupBy("_l", "_s").count()
    small = per.where(F.col("count") < least_group)
    mid = small.groupBy("_l").agg(F.sum("count").alias("all_l"))
    names = per.join(mid, "_l", "left").withColumn("g", F.when(F.col("count") >= least_group, F.concat_ws("\x01", "_l", "_s")).when(F.col("all_l") >= least_group, F.col("_l")).otherwise(F.lit("*")))
    names = stash(names.select("_l", "_s", "g"), "names")
    few = names.count() <= most_broadcast

    def lookup(df: DataFrame) -> DataFrame:
        """A row or so a group: sent to the rows, which then stay where they are, if the groups are few enough."""
        return F.broadcast(df) if few else df

    x = stash(good.join(lookup(names), ["_l", "_s"]).select("g", *(f"x{d}" for d in range(DIM))), "vectors")
    final = names.join(covariance_determinant(x, lookup, core, most_steps), "g")
    out = rows.join(lookup(final), ["_l", "_s"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    cut = chi2_quantile(quantile, DIM)
    kept = ~F.col("base_failed") & ((F.col("n") < least_group) | (F.col("distance") <= cut) | F.col("distance").isNull())
    return out.select("doc_id", *COUNTS, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), "distance")
