"""Quality classifier by importance resampling (after Xie et al., 2023).

A text's features are its hashed n-grams of 6 bytes. The target model is the multinomial of
labelled texts of good quality that are not toxic, the raw model that of all labelled texts, which are a
sample of the raw text; both are smoothed towards the n-gram counts of all documents (a Dirichlet
prior, a share of the labelled n-grams), so an n-gram that no label has seen weighs nothing either way.
A text's log ratio is the sum over its n-grams of log target less log raw.

It is read in two ways: over the whole text (the mean over its n-grams), and at its worst place
(the lowest sum over `WINDOW` n-grams), since a few bad words drown in a long text's sum. The lowest of
many sums falls with the log of their number, so it is read above what good texts of that length have, by
a least-squares line. Labelled texts that took no part in the counts give that line and put the readings on one scale, that of a log odds of being good with both sorts
as likely (a logistic fit): this is the log importance weight. Documents are drawn without replacement
by Gumbel top-k: the k largest of weight over temperature plus Gumbel noise (at 0.1 only texts near the
edge are left to chance), where k is by default the number of documents with positive weight.
The k-th largest key is found exactly by counts of ever narrower ranges of keys.

At most about `labelled` label rows are used (a bounded sample, by a hash of the id); counts,
weights and the draw cover all documents. Noise is a hash of the seed and the id, so a draw
can be repeated, and rows that share an id share it.

Nulls: a null or empty text is never drawn and has a null weight; a text of under 6 bytes
has weight 0. Label rows with a null id or null labels are ignored; of several rows for an id the
lowest quality and the highest toxicity count. Ties at the k-th key all stay, so repeated rows can make
it more than k. Without usable labels of both sorts every text is drawn. Other columns are not read here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, input_bytes, slices, utf8
from .words import U, mix

GRAM, BUCKETS, SLICE, WINDOW, PRIOR = 6, 1 << 20, 1 << 15, 8, 0.1
#: Bytes of files whose counts one sum takes in; beyond that there are two sums, each over the root of the number.
SUMMED_BYTES = 1 << 28
LABELLED = 50_000
GOOD, REST = 1, 2  # classes; those that calibrate have 2 added


def byte_grams(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of the n-gram at each byte, its row, and whether it lies within the row."""
    n = len(flat) - GRAM + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool),)
    x = np.zeros(n, U)
    for j in range(GRAM):
        x = x * U(256) + flat[j : n + j]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    return (mix(x) & U(BUCKETS - 1)).astype(np.int64), row[:n], row[:n] == row[GRAM - 1 :]


def _packed(counts: np.ndarray) -> bytes:
    top = counts.max()
    return counts.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = {k: np.zeros(BUCKETS, np.int64) for k in (0, GOOD, REST)}
    for batch in slices(batches, "text"):
        bucket, row, inside = byte_grams(*utf8(batch.column("text")))
        kind = batch.column("class").to_numpy(zero_copy_only=False)
        total[0] += np.bincount(bucket[inside], minlength=BUCKETS)
        for k in (GOOD, REST):
            if (kind == k).any():
                total[k] += np.bincount(bucket[inside & (kind[row] == k)], minlength=BUCKETS)
    for k, counts in total.items():
        if counts.any():
            for a in range(0, BUCKETS, SLICE):
                part = counts[a : a + SLICE]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["class", "at", "counts"])


def _sum(key, table):
    out = np.zeros(SLICE, np.int64)
    for raw in table.column("counts"):
        data = raw.as_py()
        out += np.frombuffer(data, f"<u{len(data) // SLICE}").astype(np.int64)
    return pa.table({"class": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([_packed(out)], pa.binary())})


def _ratios(value, names: tuple[str, str, str], text: str):
    """Appends the number of n-grams, their log ratio and the worst window to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = value.value
        for batch in slices(batches, text):
            m = batch.num_rows
            bucket, row, inside = byte_grams(*utf8(batch.column(text)))
            w = np.where(inside, ratio[bucket].astype(np.float64), 0.0) if len(bucket) else np.zeros(0)
            n = np.bincount(row[inside], minlength=m)
            total = np.bincount(row, weights=w, minlength=m)
            worst = np.zeros(m)
            if len(w) >= WINDOW:
                near = w[: len(w) - WINDOW + 1].copy()
                for j in range(1, WINDOW):
                    near += w[j : len(w) - WINDOW + 1 + j]
                near[row[: len(near)] != row[WINDOW - 1 :]] = 0.0
                np.minimum.at(worst, row[: len(near)], near)
            more = (pa.array(n, pa.int64()), pa.array(total), pa.array(worst))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return run


def log_ratios(good: np.ndarray, rest: np.ndarray, every: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log target less log raw of each bucket, from counts in good labelled texts, other labelled texts and all documents."""
    base = (every + 1e-3) / (every + 1e-3).sum()
    raw = good + rest
    weight = prior * raw.sum() + 1.0
    return np.log((good + weight * base) / (good.sum() + weight)) - np.log((raw + weight * base) / (raw.sum() + weight))


@dataclass
class Model:
    """The broadcast log ratios of all buckets (4 MB), and how a text's readings become its log importance weight: the fall of a good text's worst window by the log of its n-grams, and the terms of constant, mean and worst window."""

    ratio: object
    fall: float = 0.0
    terms: tuple[float, float, float] = (0.0, 0.0, 0.0)
    usable: bool = True

    def weight(self, n: Column, total: Column, worst: Column, text_bytes: Column) -> Column:
        level = worst + F.lit(self.fall) * F.log(n + 1.0)
        known = F.lit(self.terms[0]) + F.lit(self.terms[1]) * total / n + F.lit(self.terms[2]) * level
        return F.when(text_bytes > 0, F.when(n > 0, known if self.usable else F.lit(0.0)).otherwise(F.lit(0.0)))


def falling(length: np.ndarray, worst: np.ndarray) -> float:
    """How far the worst window of good texts falls for each unit of the log of their length, by least squares; never below 0."""
    x = length - length.mean()
    return max(0.0, -float(x @ worst / max(x @ x, 1e-9)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and weights of log p(x | y = 1) / p(x | y = 0): a logistic fit by Newton's method in which both classes weigh alike, with a slight ridge."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    share, w = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(hessian, z.T @ (share * (y - p)) - 1e-2 * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return np.concatenate([[w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, prior: float = PRIOR) -> Model:
    """docs(id, text), labels(doc_id, quality, toxic) -> a model whose counts cover all of docs."""
    rows = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    every = max(1, math.ceil(rows.count() / labelled))
    kind = F.when((F.col("q") == 1) & (F.col("t") == 0), GOOD).otherwise(REST) + F.when(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(6)) == 0, 2).otherwise(0)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("id", kind.alias("class"))
    marked = docs.join(F.broadcast(sample), "id", "left").select("id", "text", F.coalesce("class", F.lit(0)).cast("int").alias("class"))  # about `labelled` rows, by the share above
    schema = "class int, at int, counts binary"
    summed = marked.select("text", "class").mapInArrow(_counts, schema)
    if (salts := math.ceil(math.sqrt(input_bytes(docs) / SUMMED_BYTES))) > 1:  # a task's counts are a row for each slice: no sum takes in those of all tasks
        summed = summed.groupBy("class", "at", F.pmod(F.spark_partition_id(), F.lit(min(salts, 4096))).alias("salt")).applyInArrow(_sum, schema)
    summed = summed.groupBy("class", "at").applyInArrow(_sum, schema)
    counts = {k: np.zeros(BUCKETS) for k in (0, GOOD, REST)}
    for r in summed.toLocalIterator():  # at most three arrays of BUCKETS counts
        counts[r["class"]][r["at"] : r["at"] + SLICE] = np.frombuffer(r["counts"], f"<u{len(r['counts']) // SLICE}")
    model = Model(spark.sparkContext.broadcast(log_ratios(counts[GOOD], counts[REST], counts[0], prior).astype(np.float32)))
    known = marked.where("class > 2").mapInArrow(_ratios(model.ratio, ("n", "total", "worst"), "text"), "id bigint, text string, class int, n bigint, total double, worst double")
    seen = np.array([(r["class"], r["n"], r["total"], r["worst"]) for r in known.where("n > 0").select("class", "n", "total", "worst").collect()]).reshape(-1, 4)  # a sixth of the sample
    good = seen[:, 0] == GOOD + 2
    if good.sum() < 20 or (~good).sum() < 20 or not counts[GOOD].any() or not counts[REST].any():
        model.usable = False
        return model
    length = np.log(seen[:, 1] + 1.0)
    model.fall = falling(length[good], seen[good, 3])
    model.terms = tuple(map(float, logistic(np.column_stack([seen[:, 2] / seen[:, 1], seen[:, 3] + model.fall * length]), good.astype(float))))
    return model


def gumbel(id_col: Column, seed: int) -> Column:
    """Gumbel noise that depends on the id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column, exactly, by counts of 4,096 cells and then within the cell that holds it; None if there are fewer values."""
    ordered = keys.select(F.col(column).alias("x")).where("x is not null")
    lo, hi = -math.inf, math.inf
    left = k
    for _ in range(64):
        edges = ordered.where((F.col("x") >= lo) & (F.col("x") <= hi)).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("n")).first()
        if edges["n"] < left or not edges["n"]:
            return None
        a, b = edges["a"], edges["b"]
        if a == b or left == edges["n"]:
            return a
        step = (b - a) / 4096
        if a + step == a:  # neighbouring doubles: at most 4,096 different values are left
            for r in ordered.where((F.col("x") >= a) & (F.col("x") <= b)).groupBy("x").count().orderBy(F.col("x").desc()).collect():
                left -= r["count"]
                if left <= 0:
                    return r["x"]
        cell = F.least(F.floor((F.col("x") - a) / step), F.lit(4095)).cast("int")
        counts = {r["c"]: (r["n"], r["lo"], r["hi"]) for r in ordered.where((F.col("x") >= a) & (F.col("x") <= b)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
        for c in sorted(counts, reverse=True):
            n, lo, hi = counts[c]
            if n >= left:
                break
            left -= n
    return None


def weighted(docs: DataFrame, model: Model, value, id_col: str, text_col: str, seed: int, temperature: float) -> DataFrame:
    """docs with all its columns, and n_grams, log_ratio, log_weight and sample_key under names that no column of docs has."""
    import pyspark.sql.types as T

    names = tuple(_free(docs, x) for x in ("n_grams", "log_ratio", "worst_window"))
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    rows = docs.mapInArrow(_ratios(value, names, text_col), schema)
    weight = model.weight(F.col(names[0]), F.col(names[1]), F.col(names[2]), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))))
    rows = rows.withColumn(log := _free(docs, "log_weight"), weight)
    return rows.withColumn(_free(docs, "sample_key"), F.col(log) / temperature + gumbel(F.col(id_col), seed))


def _free(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def importance_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int | None = None, temperature: float = 0.1, seed: int = 1, labelled: int = LABELLED, rows: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_grams, log_ratio, log_weight, sample_key, kept; with rows=True instead the drawn rows of docs, unchanged."""
    scratch = Scratch(spark, "importance")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    model = fit(spark, source, labels, labelled=labelled)
    value = model.ratio
    scores = scratch.table("scores", weighted(source, model, value, "id", "text", seed, temperature).select(F.col("id").alias("doc_id"), "n_grams", "log_ratio", "log_weight", "sample_key"))
    if k is None:
        k = scores.where("log_weight > 0").count() if model.usable else scores.where("log_weight is not null").count()
    least = kth_largest(scores, "sample_key", k) if k else math.inf
    least = -math.inf if least is None else least
    if not rows:
        return scores.withColumn("kept", F.coalesce(F.col("sample_key") >= least, F.lit(False)))
    scratch.drop("scores")
    drawn = weighted(docs, model, value, id_col, text_col, seed, temperature)
    return drawn.where(F.col(_free(docs, "sample_key")) >= least).select(*docs.columns)
