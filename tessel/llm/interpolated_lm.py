"""Language-model scoring by deleted interpolation (Jelinek and Mercer, 1980).

A token's probability after the one before it is

    l2(b) * c(v w) / c(v) + l1(b) * c(w) / N + l0(b) / (V + 1)

with maximum-likelihood estimates of two orders and a uniform one, and weights that depend on
the bucket b of the context's frequency c(v): 0, 1, 2-3, 4-7 and so on to the number of all tokens. The weights are learned
by expectation-maximisation: a tenth of the documents that train (crc32 remainder 1) is
deleted from the counts and explained by the counts of the rest. Scores then use the
counts of all training documents.

Counting is a request and an answer. Documents are dealt into chunks by a hash, as many as the bytes of
the table need, so a chunk does not grow with the input (rows equal in id and text share one). A chunk asks for
the counts of its distinct words and word pairs, once each and with its own share of them, in one
block for each bucket of the key space; a bucket's task sums the shares of all chunks and
answers each chunk in the order it asked. So a word of a third of all tokens is one entry a chunk,
no table of counts is ever gathered in one place, and everything but nine weights a
bucket stays on the executors. Deleted documents have chunks of their own, so the EM
steps read only those.

Nulls: a null text is empty: one end token. A null id counts as the empty text for its checksum, so
the document is held out. Repeated rows count as often. An empty table gives no rows. Without deleted
documents the weights stay as they start. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, runs, tasks_for, utf8
from .words import SPACED, U, mix, rows_of, words

END = U(0x5851F42D4C957F2D)
#: Bytes of files whose counts share a bucket of the key space, and whose documents share a chunk: their tokens take some twenty times as much in memory.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 6 << 20
ASK = "bucket int, chunk int, n bigint, keys binary, core binary, deleted binary"
ANSWER = "chunk int, bucket int, core binary, deleted binary, tokens bigint, types bigint"
SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _pack(x: np.ndarray) -> bytes:
    """Counts in the fewest of 1, 2, 4 or 8 bytes each."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, all first bytes together, then all second ones: the last are zero and compress."""
    return np.ascontiguousarray(np.diff(keys, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_keys(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(-1), dtype=U)


class Chunk:
    """Tokens of a chunk's documents, in a fixed order, and its distinct keys ordered by bucket."""

    def __init__(self, table: pa.Table, buckets: int):
        table = table.sort_by([("id", "ascending"), ("remainder", "ascending"), ("text", "ascending")])
        self.ids, self.remainder = table.column("id"), table.column("remainder").to_numpy()
        flat, offs = utf8(table.column("text").cast(pa.large_string()))
        hashes, count = [], []
        for a, b in runs(offs, 1 << 20):
            found, begin = words(flat[offs[a] : offs[b]], offs[a : b + 1] - offs[a], SPACED)
            with_end = np.empty(len(found) + b - a, U)
            at = begin[1:] + np.arange(b - a)
            mask = np.ones(len(with_end), bool)
            mask[at] = False
            with_end[at], with_end[mask] = END, found
            hashes.append(with_end)
            count.append(np.diff(begin) + 1)
        tokens, self.count = (np.concatenate(hashes), np.concatenate(count)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64))
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        self.row = rows_of(self.begin)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.begin[:-1]] = END
        single = mix(tokens) & ~U(1)
        pair = mix(before * U(0x9E3779B97F4A7C15) + tokens) | U(1)
        both = np.concatenate([single, pair])
        del single, pair, before
        self.keys, at = np.unique(both, return_inverse=True)
        del both
        bucket = ((self.keys >> U(1)) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.keys, at = self.keys[order], place.astype(np.int32)[at]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        n = len(tokens)
        self.word, self.pair = at[:n], at[n:]
        self.context = np.empty(n, np.int32)
        self.context[1:] = self.word[:-1]
        if n:  # a first token follows an end, which this chunk has
            self.context[self.begin[:-1]] = self.word[self.begin[1] - 1]

    def tally(self, documents: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents of a mask."""
        mask = documents[self.row]
        return np.bincount(self.word[mask], minlength=len(self.keys)) + np.bincount(self.pair[mask], minlength=len(self.keys))

    def answered(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The counts of the whole corpus for each key: in the core, and in deleted documents."""
        core, deleted = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys), np.int64)
        for bucket, a, d in zip(answers.column("bucket").to_pylist(), answers.column("core"), answers.column("deleted"), strict=True):
            lo, hi = self.bounds[bucket], self.bounds[bucket + 1]
            core[lo:hi], deleted[lo:hi] = _unpack(a.as_py(), hi - lo), _unpack(d.as_py(), hi - lo)
        return core, deleted


def contexts(count: np.ndarray) -> np.ndarray:
    """The bucket of each context frequency."""
    return np.ceil(np.log2(count + 1)).astype(np.int64)


def n_contexts(tokens: int) -> int:
    """Buckets for contexts of any frequency in so many tokens."""
    return int(contexts(np.array([tokens]))[0]) + 1


def _ask(buckets: int):
    def run(key, table):
        chunk = Chunk(table, buckets)
        core, deleted = chunk.tally(chunk.remainder > 1), chunk.tally(chunk.remainder == 1)
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(chunk.bounds[:-1].tolist(), chunk.bounds[1:].tolist(), strict=True)) if hi > lo]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()),
                "n": pa.array([hi - lo for _, lo, hi in rows], pa.int64()),
                "keys": pa.array([_pack_keys(chunk.keys[lo:hi]) for _, lo, hi in rows], pa.binary()),
                "core": pa.array([_pack(core[lo:hi]) for _, lo, hi in rows], pa.binary()),
                "deleted": pa.array([_pack(deleted[lo:hi]) for _, lo, hi in rows], pa.binary()),
            }
        )

    return run


def _answer(key, table):
    counts = table.column("n").to_pylist()
    keys = np.concatenate([_unpack_keys(k.as_py(), n) for k, n in zip(table.column("keys"), counts, strict=True)])
    distinct, at = np.unique(keys, return_inverse=True)
    del keys
    sums = []
    for name in ("core", "deleted"):
        total = np.zeros(len(distinct), np.int64)
        b = 0
        for raw, n in zip(table.column(name), counts, strict=True):
            total[at[b : b + n]] += _unpack(raw.as_py(), n)  # a chunk asks for a key once
            b += n
        sums.append(total)
    single = (distinct & U(1)) == 0
    train = (sums[0] + sums[1])[single]
    ends = np.cumsum(counts)
    parts = [at[e - n : e] for e, n in zip(ends.tolist(), counts, strict=True)]
    m = len(parts)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int32()),
            "bucket": pa.array([key[0].as_py()] * (m + 1), pa.int32()),
            "core": pa.array([*(_pack(sums[0][p]) for p in parts), b""], pa.binary()),
            "deleted": pa.array([*(_pack(sums[1][p]) for p in parts), b""], pa.binary()),
            "tokens": pa.array([0] * m + [int(train.sum())], pa.int64()),
            "types": pa.array([0] * m + [int((train > 0).sum())], pa.int64()),
        }
    )


def _held(buckets: int):
    def run(key, docs, answers):
        chunk = Chunk(docs, buckets)
        core, _ = chunk.answered(answers)
        rows = np.stack([contexts(core[chunk.context]), core[chunk.pair], core[chunk.context], core[chunk.word]], axis=1)
        rows, n = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"b": pa.array(rows[:, 0], pa.int32()), **{c: pa.array(rows[:, i], pa.int64()) for i, c in ((1, "vw"), (2, "v"), (3, "w"))}, "n": pa.array(n, pa.int64())})

    return run


def _score(buckets: int, tokens: int, types: int, weights: dict[int, tuple[float, float, float]]):
    table = np.array([weights[b] for b in range(n_contexts(tokens))])

    def run(key, docs, answers):
        chunk = Chunk(docs, buckets)
        core, deleted = chunk.answered(answers)
        count = core + deleted
        v, vw, w = count[chunk.context], count[chunk.pair], count[chunk.word]
        own = table[contexts(v)]
        p = own[:, 0] * vw / np.maximum(v, 1) + own[:, 1] * w / max(tokens, 1) + own[:, 2] / (types + 1)
        base = np.log10((w + 0.1) / (tokens + 0.1 * (types + 1)))
        m = len(chunk.count)
        held = chunk.remainder == 0
        return pa.table(
            {
                "doc_id": chunk.ids,
                "held_out": pa.array(held),
                "n_tokens": pa.array(chunk.count, pa.int64()),
                "n_known": pa.array(np.bincount(chunk.row, weights=w > 0, minlength=m).astype(np.int64)),
                "train_tokens": pa.array(np.full(m, tokens, np.int64)),
                "base_score": pa.array(np.bincount(chunk.row, weights=base, minlength=m)),
                "score": pa.array(np.bincount(chunk.row, weights=np.log10(p), minlength=m)),
            }
        )

    return run


def fit_weights(held: DataFrame, tokens: int, types: int, *, steps: int = 20, close: float = 1e-4) -> dict[int, tuple[float, float, float]]:
    """Weights (pair, word, uniform) of each context bucket by EM over held(b, vw, v, w, n)."""
    weights = {b: (0.0, 0.9, 0.1) if b == 0 else (0.3, 0.6, 0.1) for b in range(n_contexts(tokens))}

    def of(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(float(weights[b][i])) for b in range(n_contexts(tokens)))), F.col("b") + 1)

    for _ in range(steps):
        parts = [of(0) * F.col("vw") / F.greatest("v", F.lit(1)), of(1) * F.col("w") / max(tokens, 1), of(2) / (types + 1)]
        every = parts[0] + parts[1] + parts[2]
        found = held.groupBy("b").agg(*(F.sum(F.col("n") * part / every).alias(f"p{i}") for i, part in enumerate(parts))).collect()
        moved = 0.0
        for r in found:
            total = r["p0"] + r["p1"] + r["p2"] + 3e-6
            new = tuple((r[f"p{i}"] + (0.0 if r["b"] == 0 and i == 0 else 1e-6)) / total for i in range(3))
            moved = max(moved, *(abs(x - y) for x, y in zip(new, weights[r["b"]], strict=True)))
            weights[r["b"]] = new
        if moved < close:
            break
    return weights


def interpolated_scores(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, chunks: int | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    scratch = Scratch(spark, "lm")
    buckets = tasks_for(spark, docs, BUCKET_BYTES)
    n = chunks or max(3 * buckets, tasks_for(spark, docs, CHUNK_BYTES))
    few = max(1, n // 8)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("remainder", (F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 10).cast("int"))
    dealt = F.xxhash64("id", "text")
    source = source.withColumn("chunk", F.when(F.col("remainder") == 1, F.pmod(dealt, F.lit(few)) + n).otherwise(F.pmod(dealt, F.lit(n))).cast("int"))
    asked = source.groupBy("chunk").applyInArrow(_ask(buckets), ASK)
    answers = scratch.table("answers", asked.groupBy("bucket").applyInArrow(_answer, ANSWER))
    size = answers.where("chunk = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    tokens, types = int(size["tokens"]), int(size["types"])
    replies = answers.where("chunk >= 0").select("chunk", "bucket", "core", "deleted")
    deleted = source.where("remainder = 1").groupBy("chunk").cogroup(replies.where(F.col("chunk") >= n).groupBy("chunk"))
    held = deleted.applyInArrow(_held(buckets), "b int, vw bigint, v bigint, w bigint, n bigint")
    weights = fit_weights(scratch.table("held", held.groupBy("b", "vw", "v", "w").agg(F.sum("n").alias("n"))), tokens, types)
    scratch.drop("held")
    return source.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(buckets, tokens, types, weights), SCORES)
