"""MinHash near-deduplication by a multi-index Hamming join.

A document's signature is `chunks * width` MinHash symbols of 16 bits. Two signatures that
differ in at most `chunks * (errors + 1) - 1` symbols agree, by pigeonhole, in some
chunk but for `errors` symbols. Every way to leave out `errors` symbols of a chunk is a key,
so all pairs under that distance share one. With 13 chunks of 6 symbols and one error a pair at
similarity 0.8 is met with probability 1 - 0.345^13, that is 1 - 1e-6.

1. Documents with the same shingle set are one class. Each class has one signature.
2. Of a key's classes those are tied whose signatures differ in no more symbols than pairs at the
   wanted similarity do (all but one in a million of them), so classes that only
   share a key by chance stay apart. A key of more than `group` classes ties them all to its smallest
   one instead (a star, never all pairs), which is summed before the shuffle.
   Connected components of these ties are clusters.
3. Inside a cluster the full sets are compared by inverted lists, and the links found are those
   of a spanning forest. A cluster above `block` classes or `block_shingles` shingles is split by
   set size (linked sets differ by at most 0.8 in size) and hash into blocks, one task for each pair
   of blocks, so no task holds more than two blocks.
4. Components of the links give the smallest doc_id reachable.

Shingles are 64-bit hashes of words, and a class is known by the hash of its set: two different
sets are taken for one with probability 2^-64 a pair.

Nulls: a null text has no words; documents without words are linked with nothing and
are their own component. A null id is reported, and counts as no id when the smallest is
taken. Rows that repeat an id are reported as often. Other columns are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, binary, lists, slices, utf8
from .components import connected_components
from .words import SPACED, U, mix, shingles, words

CHUNKS, WIDTH, ERRORS, GROUP, BLOCK, BLOCK_SHINGLES = 13, 6, 1, 128, 2048, 4 << 20
FILTER_BITS = 1 << 22
_rng = np.random.default_rng(8)
_PERM = _rng.integers(1, 2**63, 512, dtype=np.uint64) * U(2) + U(1)
_SLOT = _rng.integers(1, 2**63, 512, dtype=np.uint64) * U(2) + U(1)


def signatures(found: np.ndarray, count: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit symbols, a row for each non-empty set."""
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])[count > 0]
    out = np.empty((len(starts), symbols), U)
    for i in range(symbols):
        out[:, i] = np.minimum.reduceat(found * _PERM[i], starts)
    return mix(out) & U(0xFFFF)


def chunk_keys(signature: np.ndarray, chunks: int, width: int, errors: int) -> np.ndarray:
    """All keys of each signature: for each chunk, each choice of the symbols that may be wrong."""
    out, tag = [], 0
    for c in range(chunks):
        own = signature[:, c * width : (c + 1) * width]
        for kept in combinations(range(width), width - errors):
            tag += 1
            out.append(mix((own[:, kept] * _SLOT[list(kept)]).sum(axis=1, dtype=U) + U(tag) * _SLOT[-1:]))
    return np.stack(out, axis=1) if out else np.zeros((len(signature), 0), U)


def _set_hash(found: np.ndarray, count: np.ndarray) -> np.ndarray:
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])[count > 0]
    if not len(starts):
        return np.zeros(0, np.int64)
    return mix(np.add.reduceat(mix(found ^ U(0x9E3779B97F4A7C15)), starts) + count[count > 0].astype(U)).view(np.int64)


def _features(k: int, chunks: int, width: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in slices(batches, "text"):
            found, count = shingles(*words(*utf8(batch.column("text")), SPACED), k)
            some = np.flatnonzero(count)
            sets = np.full(len(count), None, object)
            sets[some] = own = _set_hash(found, count)
            first = []  # only the first document of a set in this task carries keys
            for i, h in enumerate(own.tolist()):
                if h not in met:
                    met.add(h)
                    first.append(i)
            if len(met) > 500_000:
                met.clear()
            per = np.zeros(len(count), np.int64)
            keys = np.zeros(0, np.int64)
            signed: list[bytes | None] = [None] * len(count)
            if first:
                chosen = np.zeros(len(some), bool)
                chosen[first] = True
                mask = np.repeat(chosen, count[some])
                own = signatures(found[mask], count[some][chosen], chunks * width)
                for i, raw in zip(some[chosen].tolist(), own.astype("<u2"), strict=True):
                    signed[i] = raw.tobytes()
                keys = chunk_keys(own, chunks, width, errors)
                per[some[chosen]] = keys.shape[1]
                keys = keys.reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(count, pa.int64()), pa.array(sets.tolist(), pa.int64()), lists(keys, per, pa.int64()), pa.array(signed, pa.binary())], names=["id", "n", "h", "keys", "sig"])

    return run


def farthest(symbols: int, share: int) -> int:
    """Symbols in which the signatures of a pair at the wanted similarity differ at most, but for about one pair in a million."""
    miss = 1 - share / 100
    chance, left, d = (1 - miss) ** symbols, 1.0, 0
    while True:
        left -= chance
        if left < 1e-6 or d == symbols:
            return d
        chance *= (symbols - d) / (d + 1) * miss / (1 - miss) if miss < 1 else 0.0
        d += 1


def _ties(most: int):
    """From (key, h, sig) sorted by key, ties (a, b) of classes within a key: a spanning forest of those whose signatures are near."""

    def near(h: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
        h, first = np.unique(h, return_index=True)
        close = (sig[first][:, None, :] != sig[first][None, :, :]).sum(axis=2) <= most
        label = np.arange(len(h))
        while True:  # the smallest label among a class's near ones, until none changes
            new = np.where(close, label[None, :], len(h)).min(axis=1)
            if (new == label).all():
                return [(int(h[r]), int(h[i])) for i, r in enumerate(label.tolist()) if i != r]
            label = new

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] = ()

        def ties(key: np.ndarray, h: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(begin, len(key)))
            two = begin[size == 2]
            two = two[((sig[two] != sig[two + 1]).sum(axis=1) <= most) & (h[two] != h[two + 1])]
            out = [np.stack([np.minimum(h[two], h[two + 1]), np.maximum(h[two], h[two + 1])], axis=1)]
            for a, n in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                out.append(np.array(near(h[a : a + n], sig[a : a + n]), np.int64).reshape(-1, 2))
            every = np.unique(np.concatenate(out), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(len(key), -1)
            if held:
                key, h, sig = (np.concatenate(x) for x in zip(held, (key, h, sig), strict=True))
            last = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on in the next batch
            if last:
                yield ties(key[:last], h[:last], sig[:last])
            held = (key[last:], h[last:], sig[last:])
        if held:
            yield ties(*held)

    return run


def _filter_bits(wanted: DataFrame, column: str) -> np.ndarray:
    """A Bloom filter with one hash: FILTER_BITS bits whatever the number of values, set on the executors."""
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    rows = wanted.select(F.floor(slot / 32).cast("int").alias("at"), F.expr("1L").alias("one"), (slot % 32).cast("int").alias("bit"))
    found = rows.groupBy("at").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits")).toLocalIterator(prefetchPartitions=True)
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for r in found:  # at most one row for each 32 bits
        out[r["at"]] = r["bits"]
    return out


def _sets(k: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def possible():
            for batch in batches:
                slot = batch.column("slot").to_numpy()
                mask = bits.value[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1)
                yield batch.filter(pa.array(mask.astype(bool)))

        for batch in slices(possible(), "text"):
            found, count = shingles(*words(*utf8(batch.column("text")), SPACED), k)
            some = count > 0
            at = np.concatenate([[0], np.cumsum(count)])
            yield pa.RecordBatch.from_arrays([pa.array(_set_hash(found, count), pa.int64()), binary([found[a:b].tobytes() for a, b in zip(at[:-1][some], at[1:][some], strict=True)])], names=["h", "shingles"])

    return run


def spanning_links(sets: list[np.ndarray], share: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets with 100 * intersection >= share * union."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), size)
    value, term = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(term, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(value)))])
    at = np.concatenate([[0], np.cumsum(size)])
    group = np.arange(m)
    left, out = m, []
    for i in range(m - 1):
        if left == 1:
            break
        terms = term[at[i] : at[i + 1]]
        first, last = begin[terms], begin[terms + 1]
        many = last - first > 1
        first, last = first[many], last[many]
        if not len(first):
            continue
        length = last - first
        where = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(posting[where], minlength=m)
        near = np.flatnonzero((100 * both >= share * (size[i] + size - both)) & (group != group[i]))
        for g in np.unique(group[near]).tolist():
            j = int(near[group[near] == g][0])
            out.append((i, j))
            group[group == g] = group[i]
            left -= 1
    return out


def _verify(share: int):
    def run(key, rows):
        ids = rows.column("h").to_numpy()
        _, first = np.unique(ids, return_index=True)
        column = rows.column("shingles")
        sets = [np.frombuffer(column[int(i)].as_buffer(), U) for i in first]
        links = np.array(spanning_links(sets, share) if len(sets) > 1 else [], np.int64).reshape(-1, 2)
        return pa.table({"a": ids[first[links[:, 0]]], "b": ids[first[links[:, 1]]]})

    return run


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, share: int = 80, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS, group: int = GROUP, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    scratch = Scratch(spark, "near")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    feat = scratch.table("features", source.mapInArrow(_features(k, chunks, width, errors), "id bigint, n bigint, h bigint, keys array<bigint>, sig binary"))
    classes = feat.where("h is not null").groupBy("h").agg(F.min("id").alias("rep"), F.first("n").alias("n"))

    bands = feat.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "h")
    hubs = bands.groupBy("key").agg(F.min("h").alias("hub"), F.max("h").alias("last"), F.count(F.lit(1)).alias("m")).where("hub <> last").select("key", "hub", "m")
    met = scratch.table("met", bands.join(hubs.hint("shuffle_hash"), "key"))
    stars = met.where(F.col("m") > group).where("h <> hub").select(F.col("hub").alias("a"), F.col("h").alias("b"))
    signed = feat.where("sig is not null").groupBy("h").agg(F.first("sig").alias("sig"))
    few = met.where(F.col("m") <= group).select("key", "h").join(signed, "h").repartition("key").sortWithinPartitions("key")
    stars = scratch.table("stars", stars.unionByName(few.mapInArrow(_ties(farthest(chunks * width, share)), "a bigint, b bigint")).distinct())
    scratch.drop("met")
    clusters = scratch.table("clusters", connected_components(spark, scratch, stars, "stars-cc"))

    level = F.floor(F.log("n") / F.log(F.lit(100.0 / share))).cast("int")
    nodes = scratch.table("nodes", clusters.join(classes, clusters.node == classes.h).select("h", "root", "rep", "n", level.alias("level")))
    totals = nodes.groupBy("root").agg(F.count("*").alias("total"), F.sum("n").alias("shingles")).withColumn("large", (F.col("total") > block) | (F.col("shingles") > block_shingles))
    small = nodes.join(totals.where("not large"), "root").select("h", "root", F.lit("").alias("pair"))
    subs = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).cast("int")
    levels = nodes.join(totals.where("large"), "root").groupBy("root", "level").agg(subs.alias("subs"))
    blocks = levels.select("root", "level", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"))
    own = nodes.join(levels, ["root", "level"]).select("h", "root", "level", F.pmod(F.xxhash64("h"), "subs").cast("int").alias("sub"))
    other = blocks.select("root", F.col("level").alias("level2"), F.col("sub").alias("sub2"))
    mine, its = F.format_string("%08d.%08d", "level", "sub"), F.format_string("%08d.%08d", "level2", "sub2")
    large = own.join(other, "root").where("abs(level - level2) <= 1").select("h", "root", F.concat_ws("|", F.least(mine, its), F.greatest(mine, its)).alias("pair"))
    tasks = small.unionByName(large)

    # texts are not shuffled: tasks that read them drop most others by a filter of fixed size, and the join below the rest
    bits = spark.sparkContext.broadcast(_filter_bits(nodes, "rep"))
    sets = source.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))).mapInArrow(_sets(k, bits), "h bigint, shingles binary")
    found = tasks.join(sets, "h").select("root", "pair", "h", "shingles").groupBy("root", "pair").applyInArrow(_verify(share), "a bigint, b bigint")
    links = scratch.table("links", found.distinct())
    joined = connected_components(spark, scratch, links, "links-cc")

    member = joined.join(nodes.select("h", "rep"), joined.node == F.col("h")).select("h", "root", "rep")
    smallest = member.groupBy("root").agg(F.min("rep").alias("component"))
    grouped = member.join(smallest, "root").select("h", "component")
    # written, so the last join has plain sides and AQE can split the class of many copies
    label = scratch.table("labels", classes.select("h", "rep").join(grouped, "h", "left").select("h", F.coalesce("component", "rep").alias("component")))
    scratch.drop("stars", "clusters", "nodes", "links", *(t for t in scratch.made if t.startswith(("stars-cc", "links-cc"))))
    out = feat.select("id", "n", "h").join(label, "h", "left")
    component = F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
