"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is marked (spaces become U+2581, one is put in front) and cut between each two characters
that stand side by side in no piece of the vocabulary, so no path reaches over a cut. The distinct
words between cuts are sorted, which lays out their trie, and the trie is walked depth-first: a
word keeps the forward states of the prefix it shares with the word before it and computes only
the rest.

A forward state is the last piece of the best path to a prefix. For a unigram model that
is the path with the highest sum of scores, which is part of the state. For a model of merges (the public vocabulary is one)
scores are ranks of merges, and their sum would give other pieces than the library does; there
a path is allowed if each two neighbouring pieces stay apart when merged alone, which leaves
exactly one path for each prefix, the one that merging makes. Characters without a
piece become byte pieces.

Nulls: a null or empty text has no pieces, and decodes to the empty text. Repeated rows are
reported as often. U+2581 in a text decodes to a space, as with the library; `exact` is false there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIds, lists, slices, tokenizer_path, utf8

MARK = "▁"
SPACE = 32


class Pieces:
    """A vocabulary, and the ids of words that were met."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        n = own.get_piece_size()
        self.kind = kind
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece = own.id_to_piece(i)
            if own.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (own.is_control(i) or own.is_unknown(i) or own.is_unused(i)):
                self.id[piece], self.score[piece] = i, own.get_score(i)
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.begin, self.bytes = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(self.raw), np.uint8)
        #: Which characters stand side by side in a piece; a character in no such pair is of kind 0.
        pairs = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        kinds = {c: i for i, c in enumerate(sorted({c for pair in pairs for c in pair}), 1)}
        self.kind_of = np.zeros(0x110000, np.uint16)
        for c, i in kinds.items():
            self.kind_of[ord(c)] = i
        self.kind_of[SPACE] = self.kind_of[ord(MARK)]
        self.joined = np.zeros((len(kinds) + 1, len(kinds) + 1), bool)
        for a, b in pairs:
            self.joined[kinds[a], kinds[b]] = True
        #: The longest piece by its last three characters: most places need not try long ones.
        self.longest: dict[str, int] = {}
        for p in self.id:
            self.longest[p[-3:]] = max(self.longest.get(p[-3:], 0), len(p))
        self.least = min(self.score.values(), default=0.0)
        self.apart: dict[tuple[str, str], bool] = {}
        self.table = WordIds(self._words)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging makes of a text: the best-scored neighbours join first, of equals the leftmost."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: str, right: str) -> bool:
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) > 1_500_000:
                self.apart.clear()
            found = self.apart[(left, right)] = self.merged(left + right) == [left, right]
        return found

    def segment(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of some sorted words."""
        before, length = "", [0]
        last: list[str] = [""]
        total: list[float] = [0.0]
        ids, longest, unigram = self.id, self.longest.get, self.kind == "unigram"
        apart, stay = self.apart, self._stay_apart
        for word in words:
            shared, n = 0, len(word)
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del length[shared + 1 :], last[shared + 1 :]
            if unigram:
                del total[shared + 1 :]
            for end in range(shared + 1, n + 1):
                chosen, step = None, 1
                most = longest(word[end - 3 : end], 2) if end > 2 else end
                if most > end:
                    most = end
                if unigram:
                    best = None
                    for size in range(1, most + 1):
                        piece = word[end - size : end]
                        if piece in ids:
                            s = total[end - size] + self.score[piece]
                            if best is None or s > best:
                                best, chosen, step = s, piece, size
                    if chosen is None:
                        best, chosen = total[end - 1] + self.least - 10.0, word[end - 1]
                    total.append(best)
                else:
                    for size in range(most, 0, -1):
                        piece = word[end - size : end]
                        if piece in ids:
                            left = last[end - size]
                            if not left:
                                ok = apart.get(("", piece))
                                if ok is None:
                                    ok = apart[("", piece)] = self.merged(piece) == [piece]
                            else:
                                ok = apart.get((left, piece))
                                if ok is None:
                                    ok = stay(left, piece)
                            if ok:
                                chosen, step = piece, size
                                break
                    if chosen is None:
                        chosen = word[end - 1]
                last.append(chosen)
                length.append(step)
            out, at = [], n
            while at:
                out.append(last[at])
                at -= length[at]
            out.reverse()
            yield out
            before = word

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of words, and the number of each one's."""
        marked = [w.replace(" ", MARK) for w in words]
        order = sorted(range(len(words)), key=marked.__getitem__)
        get, own = self.id.get, [()] * len(words)
        for i, pieces in zip(order, self.segment([marked[i] for i in order]), strict=True):
            ids = [get(p) for p in pieces]
            if None in ids:
                ids = [x for p, i in zip(pieces, ids, strict=True) for x in ((i,) if i is not None else map(self.byte_ids.__getitem__, p.encode()))]
            own[i] = ids
        return np.fromiter((x for ids in own for x in ids), np.int32), np.fromiter(map(len, own), np.int64, len(own))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of all texts, the number of each one's, and whether they decode to the text."""
        flat, offs = utf8(texts)
        some = np.diff(offs) > 0
        if not some.any():
            return np.zeros(0, np.int32), np.zeros(len(some), np.int64), np.ones(len(some), bool)
        flat = np.insert(flat, offs[:-1][some], SPACE)
        offs = offs + np.concatenate([[0], np.cumsum(some)])
        at = np.flatnonzero((flat & 0xC0) != 0x80)  # of characters
        kinds = self.kind_of[np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(at), bool)
        cut[1:] = ~self.joined[kinds[:-1], kinds[1:]]
        cut[np.searchsorted(at, offs[:-1][some])] = True
        begin = at[cut]
        offsets = np.concatenate([begin, [len(flat)]]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(flat))
        ids, count = self.table.of(words, np.searchsorted(begin, offs))
        # decoded all at once and held against the bytes that came
        size, ends = self.size[ids], np.concatenate([[0], np.cumsum(count)])
        made = np.concatenate([[0], np.cumsum(size)])
        back = self.bytes[np.repeat(self.begin[ids] - made[:-1], size) + np.arange(made[-1])]
        length, want = np.diff(made[ends]), np.diff(offs)
        exact = length == want
        wrong = np.flatnonzero(back[np.repeat(exact, length)] != flat[np.repeat(exact, want)])
        if len(wrong):
            exact[np.flatnonzero(exact)[np.unique(np.searchsorted(np.cumsum(want[exact]), wrong, "right"))]] = False
        return ids, count, exact

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        ids, count, _ = self.flat(pa.array(texts, pa.string()))
        packed, ends = ids.tobytes(), 4 * np.cumsum(count)
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids.tolist()))
        return raw[1:].decode(errors="replace") if raw[:1] == b" " else raw.decode(errors="replace")


@lru_cache(maxsize=2)
def vocabulary(path: str, kind: str = "bpe") -> Pieces:
    """A model with what it has learned; kept by a worker process from task to task."""
    return Pieces(path, kind)


def _encode(path: str, kind: str, text: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path, kind)
        for batch in slices(batches, text, 4 << 20):
            ids, count, exact = pieces.flat(batch.column(text))
            more = (lists(ids, count, pa.int32()), pa.array(count, pa.int64()), pa.array(exact))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    return run


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text", *, kind: str = "bpe") -> DataFrame:
    """docs with all its columns and piece_ids, n_pieces and exact (decoding the ids gives the text back), under free names."""
    import pyspark.sql.types as T

    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("piece_ids", "n_pieces", "exact"):
        while name in taken:
            name += "_"
        names.append(name)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(_encode(tokenizer_path(model), kind, text_col, tuple(names)), schema)


def piece_ids(spark: SparkSession, docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text", *, kind: str = "bpe") -> DataFrame:
    """One row for each row of docs: doc_id, piece_ids, n_pieces, exact."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return encode_pieces(source, model, "text", kind=kind).drop("text")


def decode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "piece_ids", out_col: str = "text") -> DataFrame:
    """docs with the text of an array of ids; a null array decodes to null."""
    path = tokenizer_path(model)
    import pyspark.sql.types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else pieces.decode(np.array(x, np.int64)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))
