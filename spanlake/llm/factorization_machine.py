"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the features and
rank. Features: lower-cased words hashed to ``bits`` bits with weights log(1 + count), normed, and structure statistics of
the text in bins. The model is fitted on a bounded sample of labelled documents and has a fixed size, whatever the corpus.

It is trained until its loss settles, by updates and not by passes, so few labels get as many steps as many. Scores are
calibrated: models fitted on one half of the sample score the other, and a logistic curve through all those scores
and labels maps the final model's sums to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .shared import drop, stash
from .text_stats import counts

U = np.uint64
BITS, BINS = 16, 12


def structure(c: dict[str, np.ndarray]) -> np.ndarray:
    """Bins of the structure statistics, a column for each."""
    n, size, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_bytes"], 1), np.maximum(c["word_chars"], 1)
    shares = (
        np.log2(1 + c["n_words"]) * 0.8,
        chars / n * 1.2 - 1,
        np.log2(1 + 400 * c["n_symbols"] / size),
        np.log2(1 + 200 * c["n_digits"] / size),
        np.log2(1 + 200 * c["n_upper"] / size),
        np.log2(1 + 200 * c["n_marks"] / size),
        np.log2(1 + 200 * c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
        np.log2(1 + 200 * c["n_repeat_words"] / n),
        np.log2(1 + n / c["n_lines"]),
    )
    return np.clip(np.stack(shares, 1), 0, BINS - 1).astype(np.int64)


KINDS = 9
WIDTH = (1 << BITS) + KINDS * BINS


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids, values and bounds of every row."""
    c = counts(buf, off)
    h, _, _, at = B.words(buf, off, lower=True)
    rows = len(off) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    key = (row << BITS) | (h >> U(64 - BITS)).astype(np.int64)
    key, tf = np.unique(key, return_counts=True)
    row, idx = key >> BITS, key & ((1 << BITS) - 1)
    val = np.log1p(tf)
    norm = np.sqrt(np.bincount(row, val * val, minlength=rows))
    val = val / np.maximum(norm[row], 1e-9)
    bins = structure(c) + (1 << BITS) + np.arange(KINDS) * BINS
    row = np.concatenate([row, np.repeat(np.arange(rows), KINDS)])
    idx, val = np.concatenate([idx, bins.reshape(-1)]), np.concatenate([val, np.full(rows * KINDS, 1 / np.sqrt(KINDS))])
    order = np.argsort(row, kind="stable")
    return idx[order], val[order].astype(np.float32), np.searchsorted(row[order], np.arange(rows + 1))


def logits(model: tuple[float, np.ndarray, np.ndarray], idx: np.ndarray, val: np.ndarray, at: np.ndarray) -> np.ndarray:
    b, w, v = model
    vx = v[idx] * val[:, None]
    s, q = np.add.reduceat(vx, at[:-1], axis=0), np.add.reduceat(vx * vx, at[:-1], axis=0)
    return b + np.add.reduceat(w[idx] * val, at[:-1]) + 0.5 * (s * s - q).sum(1)


def _joined(rows: list[tuple[np.ndarray, np.ndarray]], part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
    return idx, val, np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in part])])


def descend(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rank: int, rate: float, decay: float, batch: int, least_updates: int, most_updates: int, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss, adaptive gradients, until a pass lowers the mean loss by less than a fiftieth."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, rank)).astype(np.float32)
    prior = float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.5
    b = float(np.log(prior / (1 - prior)))
    if len(label) == 0 or label.min() == label.max():
        return b, w, v * 0
    gw, gv, gb = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, rank), 1e-6, np.float32), 1e-6
    here, column = np.zeros(WIDTH, bool), np.zeros(WIDTH, np.int64)
    updates, last = 0, np.inf
    while updates < most_updates:
        order, loss = rng.permutation(len(rows)), 0.0
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            idx, val, at = _joined(rows, part)
            here[idx] = True
            ids = np.flatnonzero(here)  # the batch's features: the columns of a small dense matrix
            here[ids] = False
            column[ids] = np.arange(len(ids))
            x = np.zeros((len(part), len(ids)), np.float32)
            x[np.repeat(np.arange(len(part)), np.diff(at)), column[idx]] = val
            vi, x2 = v[ids], x * x
            s = x @ vi
            z = np.clip(b + x @ w[ids] + 0.5 * (s * s - x2 @ (vi * vi)).sum(1), -30, 30)
            loss += float(np.logaddexp(0, np.where(label[part] > 0, -z, z)).sum())
            g = (1 / (1 + np.exp(-z)) - label[part]).astype(np.float32) / len(part)
            dw = g @ x + decay * w[ids]
            dv = x.T @ (g[:, None] * s) - (g @ x2)[:, None] * vi + decay * vi
            gw[ids] += dw * dw
            gv[ids] += dv * dv
            w[ids] -= rate * dw / np.sqrt(gw[ids])
            v[ids] -= rate * 0.5 * dv / np.sqrt(gv[ids])
            gb += float(g.sum()) ** 2
            b -= rate * float(g.sum()) / gb**0.5
            updates += 1
        if updates >= least_updates and loss > 0.98 * last:
            break
        last = loss
    return b, w, v


def curve(z: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through sums and labels; the targets keep off 0 and 1 by the classes' sizes."""
    ones = float(label.sum())
    target = np.where(label > 0, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([z, np.ones(len(z))], 1).astype(np.float64)
    c = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
        c -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(c[0]), float(c[1])) if c[0] > 0 else (1.0, 0.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rank: int = 8, rate: float = 0.05, decay: float = 1e-6, batch: int = 64, least_updates: int = 100, most_updates: int = 300, folds: int = 2, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """A calibrated model, with slope and offset of the curve folded into it. One class only: its prior."""
    how = (rank, rate, decay, batch, least_updates, most_updates, seed)
    b, w, v = descend(rows, label, *how)
    if len(label) < 2 * folds or label.min() == label.max():
        return b, w, v
    fold = np.random.default_rng(seed).permutation(len(rows)) % folds
    z = np.zeros(len(rows))
    for f in range(folds):
        out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
        z[out] = logits(descend([rows[i] for i in rest], label[rest], *how), *_joined(rows, out))
    slope, offset = curve(z, label)
    return slope * b + offset, (slope * w).astype(np.float32), (np.sqrt(slope) * v).astype(np.float32)


def _features(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            buf, off = B.column(batch, "text")
            for i, j in B.slices(off):
                idx, val, at = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                cells = zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
                body = [(idx[a:b].astype(np.uint32).tobytes(), val[a:b].tobytes()) for a, b in cells]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([x for x, _ in body], pa.binary()), pa.array([x for _, x in body], pa.binary())], [*keep, "idx", "val"])

    return run


def _fitted(how: dict):
    def run(table: pa.Table) -> pa.Table:
        B.release()
        table = table.sort_by("_id")
        cells = [(np.frombuffer(i.as_py(), np.uint32).astype(np.int64), np.frombuffer(v.as_py(), np.float32)) for i, v in zip(table.column("idx"), table.column("val"), strict=True)]
        b, w, v = fit(cells, table.column("_label").to_numpy().astype(np.float32), **how)
        return pa.table({"b": pa.array([b], pa.float64()), "w": pa.array([w.tobytes()], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})

    return run


def _scores(model, keep: list[str], score_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            B.release()
            buf, off = B.column(batch, "__text")
            for i, j in B.slices(off):
                z = logits(model.value, *features(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                part = batch.slice(i, j - i)
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(p)], [*keep, score_col])

    return run


def held_out(key, folds: int = 5, held: int = 0):
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == held, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 12000, most_features: int = 4_000_000, folds: int = 5, held: int = 0, **how):
    """The model, from at most ``sample`` labelled ids outside the held-out fold, those of smallest hash.

    Of those, the first whose distinct words together stay below ``most_features`` are used, 8 bytes each. It is fitted
    in one task: the driver, which has the least memory, sees the sample's sizes and the model only.
    Labels that are null or have a null id are ignored; of several labels of one id, the smallest holds, and of several
    texts of one id the one of the smallest hash.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id is not null and _label is not null")
    known = known.where(~held_out(F.col("_id"), folds, held)).groupBy("_id").agg(F.min("_label").alias("_label"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(known), "_id").mapInArrow(_features(["_id", "_label"]), "_id long, _label int, idx binary, val binary")
    found = stash(found.groupBy("_id").agg(F.first("_label").alias("_label"), F.min_by(F.struct("idx", "val"), F.xxhash64("idx", "val")).alias("x")), "features")
    sizes = found.select("_id", F.xxhash64("_id").alias("h"), (F.octet_length("x.idx") / 4).cast("long").alias("n")).toArrow().sort_by([("h", "ascending"), ("_id", "ascending")])
    fits = np.cumsum(sizes.column("n").to_numpy()) <= most_features
    edge = sizes.column("h").to_numpy()[fits][-1:].tolist()
    rows = found.where(F.xxhash64("_id") <= (edge[0] if edge else -(1 << 63))).select("_id", "_label", "x.idx", "x.val")
    told = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fitted(how), "b double, w binary, v binary").collect()
    drop(found)
    if not told:
        return fit([], np.zeros(0, np.float32), **how)
    b, w, v = told[0]
    return b, np.frombuffer(w, np.float32), np.frombuffer(v, np.float32).reshape(WIDTH, -1)


def score_quality(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the model's score in [0, 1]. Null and empty texts have a score like any other text without words."""
    keep = [c for c in docs.columns if c != score_col]
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text_col).cast("string").alias("__text"))
    kinds = dict(given.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{score_col}` double"
    return given.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(model), keep, score_col), schema)
