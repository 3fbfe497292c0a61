"""Benchmark decontamination by winnowing fingerprints.

Winnowing (Schleimer et al., 2003) keeps the smallest k-gram hash of each run of w
consecutive k-grams, so any shared span of w + k - 1 words holds a k-gram that both
sides keep: with k = 5 and w = 6, every span of ten words. Kept hashes of documents
and items are joined, each meeting place is extended over equal words in both directions,
and spans of ten words or more are hits. An item of fewer than ten words is one window;
it is found by the hash of its first min(k, words) words at every place of a document and
compared whole.

The item side travels to the tasks in blocks of at most `block_words` words, a
bound checked by a running sum over the items. With one block no document row is shuffled.
A larger benchmark takes more blocks, each against all documents: these are numbered and
written once, and the hits of later blocks join by that number the rows of the first.

Words are compared by 64-bit hashes until a place of a span is found; there the words
themselves are compared, so no hit rests on a hash.

Nulls: a null text has no words. An item without words is never found. Repeated documents are
reported as often as they occur. Items that share an id count as one item, and so do those
without an id, which are null in `items` and not in the digest. Other columns of both
tables are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, utf8
from .words import ALNUM, grams, rows_of, words

K, WINDOW = 5, 10
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
HITS = "row bigint, doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<bigint>, spans array<struct<begin:bigint,end:bigint>>"


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the smallest (last of equals) of each w consecutive hashes."""
    if len(hashes) < w:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(len(view)) + (w - 1) - np.argmin(view[:, ::-1], axis=1))


class ItemIndex:
    """Words of all items of a block, the fingerprints of long ones and the openings of short ones, sorted by hash."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int = K, window: int = WINDOW):
        self.k, self.window, self.texts, self.split = k, window, texts, {}
        flat, offs = utf8(pa.array(texts, pa.large_string()))
        self.words, self.begin = words(flat, offs, ALNUM)
        self.ids = ids
        every, at = grams(self.words, k), []
        count = np.diff(self.begin)
        for item in np.flatnonzero(count >= window):
            b, e = self.begin[item], self.begin[item + 1]
            at.append(b + winnow(every[b : e - k + 1], window - k + 1))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        order = np.argsort(every[at], kind="stable")
        self.at, self.keys = at[order], every[at][order]
        self.item = np.searchsorted(self.begin, self.at, "right") - 1
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in range(1, window):
            own = np.flatnonzero(count == size)
            if len(own):
                whole = np.concatenate([grams(self.words[self.begin[i] : self.begin[i + 1]], size) for i in own])
                order = np.argsort(whole, kind="stable")
                self.short[size] = (whole[order], own[order])

    def item_words(self, item: int) -> list[str]:
        if item not in self.split:
            self.split[item] = words_of(self.texts[item])
        return self.split[item]

    def hits(self, doc: np.ndarray, said: Callable[[], list[str]]) -> tuple[set[int], list[tuple[int, int]]]:
        """Items (by number) with a window in a document, and the spans [begin, end) that windows cover; said: the document's words."""
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        k, w = self.k, self.window
        if len(doc) >= w and len(self.keys):
            every = grams(doc, k)
            kept = winnow(every, w - k + 1)
            lo, hi = np.searchsorted(self.keys, every[kept], "left"), np.searchsorted(self.keys, every[kept], "right")
            seen: dict[tuple[int, int], int] = {}  # (item, diagonal) -> document position up to which it is extended
            for p, a, b in zip(kept[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for j in range(a, b):
                    q, item = int(self.at[j]), int(self.item[j])
                    if seen.get((item, q - p), -1) >= p + k:
                        continue
                    b0, e0 = int(self.begin[item]), int(self.begin[item + 1])
                    back = min(p, q - b0)
                    diff = np.flatnonzero(doc[p - back : p] != self.words[q - back : q])
                    left = back - (int(diff[-1]) + 1) if len(diff) else back
                    ahead = min(len(doc) - p, e0 - q)
                    diff = np.flatnonzero(doc[p : p + ahead] != self.words[q : q + ahead])
                    right = int(diff[0]) if len(diff) else ahead
                    seen[(item, q - p)] = p + right
                    for x, y in equal_runs(said()[p - left : p + right], self.item_words(item)[q - left - b0 : q + right - b0]) if left + right >= w else ():
                        if y - x >= w:
                            spans.add((p - left + x, p - left + y))
                            items.add(item)
        for size, (keys, own) in self.short.items():
            if len(doc) >= size:
                every = grams(doc, size)
                lo, hi = np.searchsorted(keys, every, "left"), np.searchsorted(keys, every, "right")
                for p in np.flatnonzero(hi > lo).tolist():
                    for item in own[lo[p] : hi[p]].tolist():
                        if item in items and (p, p + size) in spans:
                            continue
                        if said()[p : p + size] == self.item_words(item):
                            spans.add((p, p + size))
                            items.add(item)
        return items, sorted(spans)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def equal_runs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The stretches over which two lists are equal: one, unless hashes of different words met."""
    if a == b:
        return [(0, len(a))]
    out, begin = [], 0
    for i in range(len(a) + 1):
        if i == len(a) or a[i] != b[i]:
            if i > begin:
                out.append((begin, i))
            begin = i + 1
    return out


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in spans:
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [tuple(x) for x in out]


def _result(rows: list[tuple]) -> pa.RecordBatch:
    """From (row, doc_id, number of words, items, spans)."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))
    names = ["row", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"]
    out = []
    for row, doc, n, items, spans in rows:
        spans = united(spans)
        hit = sum(e - b for b, e in spans)
        named = sorted((x for x in items if x is not None), key=str)
        digest = hashlib.sha256(",".join(map(str, named)).encode()).hexdigest()
        out.append((row, doc, n, hit, len(items), digest, hit > 0, named + [None] * (None in items), [{"begin": b, "end": e} for b, e in spans]))
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _scan(index, load, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ItemIndex = load(index.value)
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            hashes, begin = words(*utf8(texts), ALNUM)
            may, rows = _candidates(hashes, begin, own), []
            for r, (row, doc) in enumerate(zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), strict=True)):
                items, spans = set(), []
                if may[r]:
                    held: list[list[str]] = []

                    def said(r=r, held=held) -> list[str]:
                        if not held:
                            held.append(words_of(texts[r].as_py()))
                        return held[0]

                    items, spans = own.hits(hashes[begin[r] : begin[r + 1]], said)
                if spans or all_rows:
                    rows.append((row, doc, int(begin[r + 1] - begin[r]), {own.ids[i] for i in items}, spans))
            if rows:
                yield _result(rows)

    return run


def _candidates(hashes: np.ndarray, begin: np.ndarray, index: ItemIndex) -> np.ndarray:
    """Rows of a batch that hold any k-gram of the index or any short item: a superset of the rows with hits."""
    may = np.zeros(len(begin) - 1, bool)
    row = rows_of(begin)
    for size, keys in [(index.k, index.keys), *((s, k) for s, (k, _) in index.short.items())]:
        every = grams(hashes, size)
        if len(every) and len(keys):
            near = keys[np.minimum(np.searchsorted(keys, every), len(keys) - 1)] == every
            at = np.flatnonzero(near)
            may[row[at[row[at] == row[at + size - 1]]]] = True
    return may


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items in blocks of at most so many words; one empty block if there are none."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    ids, texts, held = [], [], 0
    for row in items.toLocalIterator():
        size = len(row["text"]) // 2 + 1
        if ids and held + size > block_words:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        held += size
    yield ids, texts


def benchmark_overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = K, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items and the word spans that are hit."""
    if not 0 < k <= window:
        raise ValueError("k must be at least 1 and at most the window")
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def load(packed):
        return ItemIndex(*packed, k, window)

    ahead = _blocks(benchmark, item_col, item_text_col, block_words)
    first, second = next(ahead), next(ahead, None)
    if second is None:
        return source.mapInArrow(_scan(spark.sparkContext.broadcast(first), load, True), HITS).drop("row")
    scratch = Scratch(spark, "overlap")
    source = scratch.table("numbered", source)  # the same numbers for every block, however the rows come
    found = scratch.table("block-0", source.mapInArrow(_scan(spark.sparkContext.broadcast(first), load, True), HITS))
    more = None
    for i, block in enumerate(chain([second], ahead), 1):
        own = scratch.table(f"block-{i}", source.mapInArrow(_scan(spark.sparkContext.broadcast(block), load, False), HITS))
        more = own if more is None else more.unionByName(own)
    scratch.drop("numbered")
    return _unite(found, more).drop("row")


def without_overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, k: int = K, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns: one filter for each block, and no row moves."""
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(block), k, window, text_col), docs.schema)
    return docs


def _clean(index, k: int, window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ItemIndex(*index.value, k, window)
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            hashes, begin = words(*utf8(texts), ALNUM)
            keep = ~_candidates(hashes, begin, own)
            for r in np.flatnonzero(~keep).tolist():
                keep[r] = not own.hits(hashes[begin[r] : begin[r + 1]], lambda r=r: words_of(texts[r].as_py()))[1]
            yield batch.filter(pa.array(keep))

    return run


def _unite(found: DataFrame, more: DataFrame) -> DataFrame:
    """All rows with the hits of the first block, and the rows that later blocks hit: each row with the hits of all blocks."""

    def run(key, table):
        rows = table.to_pylist()
        items = {x for r in rows for x in r["items"]}
        spans = sorted({(s["begin"], s["end"]) for r in rows for s in r["spans"]})
        return pa.Table.from_batches([_result([(rows[0]["row"], rows[0]["doc_id"], rows[0]["n_words"], items, spans)])])

    touched = more.select("row").distinct()
    again = found.join(touched, "row", "left_semi").unionByName(more).groupBy("row").applyInArrow(run, HITS)  # a row for each block
    return found.join(touched, "row", "left_anti").unionByName(again)
