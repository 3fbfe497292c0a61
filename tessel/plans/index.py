"""The index: built from a corpus of line-delimited files as Parquet tables, and searched in batches of requests."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.passages import Counter, passages
from ..functions.text import excerpt, folded, lines, match_key, non_blank
from ..operators import ranking, retrieval
from ..operators.hierarchy import leaves
from ..sources.jsonl import read_jsonl

VERSION = "2"
LAWS = "doc_id string, title string, jurisdiction string, language string, law_family string, source_url string, version_date string, effective_date string"
LEGAL_UNITS = "unit_id string, source_doc_id string, parent_id string, unit_type string, canonical_citation string, local_citation string, text string, jurisdiction string, law_name string, effective_from string, effective_to string, is_current boolean"
CASES = "case_id string, title string, authority string, jurisdiction string, country string, decided_date string, case_number string, ecli string, company_or_parties string, facts_text string, decision_text string, outcome string, source_url string, original_source_url string, industry array<struct<industry:string>>, categories array<string>"
CASE_RELATIONS = "case_id string, target_unit_id string, citation string, resolution_status string"
LAW_RELATIONS = "source_unit_id string, target_unit_id string, relation_scope string"
Embed = Callable[[list[str]], list[list[float]]]


def hash_embedder(dim: int = 32) -> Embed:
    """Deterministic embeddings for tests: each word adds one at a place that its SHA-256 names; unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        at = [i * dim + _place(w) % dim for i, text in enumerate(texts) for w in _WORD.findall(text.casefold())]
        sums = np.bincount(np.array(at, np.int64), minlength=len(texts) * dim).reshape(len(texts), dim).astype(np.float64)
        return (sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)).tolist()

    return embed


_WORD = re.compile(r"[\w㐀-鿿]+")


@lru_cache(maxsize=1 << 16)
def _place(word: str) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest()[:2], "big")


#: Bytes of vectors that a task holds before they go on.
VECTOR_BYTES = 8 << 20


def embedded(rows: DataFrame, text: str, embed: Embed, batch: int = 64) -> DataFrame:
    """rows with an embedding of a text column in place of it; texts go to the model in small batches (E1), and vectors on to Spark in larger ones."""
    kept = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, held, size = 0, [], 0
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = embed([t or "" for t in part.column(text).to_pylist()])
                if len(vectors) != part.num_rows or len({len(v) for v in vectors}) > 1:
                    raise ValueError("the embedder gave vectors of another number or of unequal length")
                held.append(np.array(vectors, np.float32))
                size += held[-1].nbytes
                if size >= VECTOR_BYTES or at + batch >= b.num_rows:
                    own = b.slice(begin, at + part.num_rows - begin)
                    ends = np.cumsum([0, *(v.shape[1] for v in held for _ in range(len(v)))], dtype=np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.reshape(-1) for v in held])))
                    yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), column], names=[*kept, "embedding"])
                    begin, held, size = at + part.num_rows, [], 0

    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    return rows.mapInArrow(run, f"{schema}, embedding array<float>")


def records(spark: SparkSession, corpus: str) -> dict[str, DataFrame]:
    """Laws, current units with their keys and cases with a text, as plans over a corpus folder."""
    cases = _read(spark, corpus, "gdprhub_cases", CASES).where(non_blank(F.col("facts_text")).isNotNull() | non_blank(F.col("decision_text")).isNotNull())
    return {
        "laws": _read(spark, corpus, "laws", LAWS),
        "units": _read(spark, corpus, "legal_units", LEGAL_UNITS).where("is_current").withColumnRenamed("source_doc_id", "doc_id").withColumn("citation_key", match_key(folded(F.col("local_citation")))),
        "cases": cases.withColumn("industries", F.transform("industry", lambda i: i["industry"])).drop("industry"),
    }


def _read(spark: SparkSession, corpus: str, name: str, schema: str) -> DataFrame:
    return read_jsonl(spark, f"{corpus}/{name}.jsonl", schema)


def derived(spark: SparkSession, corpus: str, base: Mapping[str, DataFrame], embed: Embed, *, threshold: int = 1600, target: int = 800, most: int = 1000, overlap: int = 100, counter: Counter = Counter()) -> dict[str, DataFrame]:
    """The tables that follow from the records: links, vectors and passages."""
    laws, units, cases = base["laws"], base["units"], base["cases"]
    links = _read(spark, corpus, "case_law_relations", CASE_RELATIONS).where("resolution_status = 'resolved'")
    # units first: what is dealt out by case for the second join stays there while repeats are dropped
    links = links.join(units.select(F.col("unit_id").alias("target_unit_id")), "target_unit_id", "left_semi").join(cases.select("case_id"), "case_id", "left_semi").dropDuplicates(["case_id", "target_unit_id", "citation"])
    cross = _read(spark, corpus, "law_relations", LAW_RELATIONS).where("relation_scope = 'cross_law'")
    for end in ("source_unit_id", "target_unit_id"):
        cross = cross.join(units.select(F.col("unit_id").alias(end)), end, "left_semi")
    leaf = leaves(units).join(laws.select("doc_id", F.col("title").alias("law_title")), "doc_id")
    law_text = lines(F.col("law_title"), F.col("jurisdiction"), F.col("canonical_citation"), F.col("text"))
    case_text = lines(F.col("title"), F.col("authority"), F.col("country"), F.array_join("industries", ", "), F.array_join("categories", ", "), F.col("facts_text"), F.col("decision_text"))
    none = F.lit(None).cast("string")
    documents = leaf.select(F.concat(F.lit("law_unit:"), "unit_id").alias("evidence_id"), F.lit("law").alias("source_type"), F.col("unit_id").alias("record_id"), "jurisdiction", none.alias("country"), "doc_id", none.alias("decided_date"), law_text.alias("embedding_text")).unionByName(
        cases.select(F.concat(F.lit("case:"), "case_id").alias("evidence_id"), F.lit("case").alias("source_type"), F.col("case_id").alias("record_id"), "jurisdiction", "country", none.alias("doc_id"), "decided_date", case_text.alias("embedding_text"))
    )
    segment = lambda name, text: F.struct(F.lit(name).alias("segment"), F.coalesce(text, F.lit("")).alias("text"))
    parted = leaf.select(F.concat(F.lit("law_unit:"), "unit_id").alias("parent_id"), F.array(segment("text", F.col("text"))).alias("segments")).unionByName(cases.select(F.concat(F.lit("case:"), "case_id").alias("parent_id"), F.array(segment("facts", F.col("facts_text")), segment("decision", F.col("decision_text"))).alias("segments")))
    pieces = passages(parted, threshold=threshold, target=target, most=most, overlap=overlap, counter=counter)
    # a parent's id says what it is of, so its documents need not be joined
    pieces = pieces.withColumn("source_type", F.when(F.col("parent_id").startswith("law_unit:"), "law").otherwise("case")).withColumn("embedding_text", lines(F.col("segment"), F.col("text")))
    return {
        "case_law": links.select("case_id", "target_unit_id", "citation"), "cross_law": cross.select("source_unit_id", "target_unit_id"),
        "vectors": embedded(documents.withColumn("text_sha256", F.sha2("embedding_text", 256)), "embedding_text", embed), "passages": embedded(pieces, "embedding_text", embed),
    }


def tables(spark: SparkSession, corpus: str, embed: Embed, **limits) -> dict[str, DataFrame]:
    """The index's tables as plans over a corpus folder; nothing is read yet."""
    base = records(spark, corpus)
    return {**base, **derived(spark, corpus, base, embed, **limits)}


def build(spark: SparkSession, corpus: str, out: str, embed: Embed, model: str, dim: int, **limits) -> dict:
    """Writes a new version of the index and then points `out` at it; returns its counts. A failed build leaves the old version in use.

    Links, vectors and passages are made from the records as they were written, so lines of JSON are read once.
    """
    version = f"v-{uuid.uuid4().hex}"
    back = lambda name: spark.read.parquet(f"{out}/{version}/{name}")
    for name, df in (base := records(spark, corpus)).items():
        df.write.parquet(f"{out}/{version}/{name}")
    for name, df in derived(spark, corpus, {name: back(name) for name in base}, embed, **limits).items():
        df.write.parquet(f"{out}/{version}/{name}")
    counts = {name: back(name).count() for name in ("laws", "units", "cases", "case_law", "cross_law", "vectors", "passages")}
    meta = {"schema_version": VERSION, "model": model, "dim": dim, "version": version, **counts}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/current")
    return meta


class Index:
    """An index that is open; all searches are plans that keep requests apart by request_id."""

    def __init__(self, spark: SparkSession, path: str, embed: Embed, model: str):
        self.spark, self.embed = spark, embed
        self.meta = json.loads(spark.read.text(f"{path}/current").first()["value"])
        if self.meta["schema_version"] != VERSION or self.meta["model"] != model:
            raise ValueError("the index was built by another version or model")
        hadoop = spark._jvm.org.apache.hadoop.fs
        for name in ("laws", "units", "cases", "case_law", "cross_law", "vectors", "passages"):
            at = hadoop.Path(f"{path}/{self.meta['version']}/{name}")
            if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                raise FileNotFoundError(f"the index lacks {name}")
        if (dim := len(embed([""])[0])) != self.meta["dim"]:
            raise ValueError(f"the index holds vectors of {self.meta['dim']} numbers, the model gives {dim}")
        self.table = lambda name: spark.read.parquet(f"{path}/{self.meta['version']}/{name}")

    def exact(self, citations: DataFrame) -> DataFrame:
        """Units of citations(request_id, doc_id, wanted, position), each once at its first position."""
        found = retrieval.exact_lookup(self.table("units"), citations.drop("request_id").distinct(), fold=True)
        rows = found.join(citations.select("request_id", "doc_id", "wanted", "position"), ["doc_id", "wanted", "position"])
        return ranking.first_wins(rows.select("request_id", "unit_id", "position", F.lit(1.0).alias("score")), ["request_id", "unit_id"], "position")

    def search(self, requests: Sequence[tuple[str, str]], keep: Column | None = None, limit: int = 20, among: DataFrame | None = None) -> DataFrame:
        """The diverse best `limit` documents of each request, with their passages (Q3). requests: (request_id, query text), repeats and blanks are left out; among: a table of the record_ids that may be found."""
        asked = list(dict.fromkeys((r, q.strip()) for r, q in requests if q.strip()))
        if not asked:
            return self.spark.createDataFrame([], "request_id string, evidence_id string, source_type string, record_id string, score double, rank int, passages array<string>")
        vectors = self.embed([q for _, q in asked])
        side = self.spark.createDataFrame([(r, [float(x) for x in v]) for (r, _), v in zip(asked, vectors, strict=True)], "request_id string, query array<double>")
        documents = self.table("vectors") if keep is None else self.table("vectors").where(keep)
        if among is not None:
            documents = documents.join(among.select("record_id").distinct(), "record_id", "left_semi")
        scored = retrieval.scores_by_request(documents.select("evidence_id", "source_type", "record_id", "embedding"), side, "request_id")
        ranked = ranking.diverse_top(scored, ["request_id"], "source_type", "score", "evidence_id", limit)
        parents = ranked.select("request_id", F.col("evidence_id").alias("parent_id"))
        pieces = retrieval.scores_by_request(self.table("passages").join(parents.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", "passage_id", "embedding"), side, "request_id")
        out = retrieval.refine_by_passages(ranked.withColumnRenamed("evidence_id", "parent_id"), pieces, ["request_id"], "parent_id", "passage_id", "score", max(3 * limit, 30))
        return out.select("request_id", F.col("parent_id").alias("evidence_id"), "source_type", "record_id", "score", "rank", "passages")

    def related(self, cases: DataFrame, limit: int) -> DataFrame:
        """Units that the cases of cases(request_id, case_id) apply, the first `limit` by id (Q4)."""
        links = cases.join(self.table("case_law").select("case_id", F.col("target_unit_id").alias("unit_id")), "case_id")
        return retrieval.related(links, self.table("units").select("unit_id", "doc_id", "canonical_citation"), self.table("laws").select("doc_id", "title"), "request_id", "unit_id", "doc_id", limit)

    def evidence(self, ranked: DataFrame, preview: bool) -> DataFrame:
        """ranked(request_id, evidence_id, source_type, record_id, rank, ...) with title, citation and text: an excerpt, or the whole and all passages."""
        cut = (lambda c, n=1000: excerpt(c, n)) if preview else (lambda c, n=0: c)
        law = self.table("units").join(self.table("laws").select("doc_id", F.col("title").alias("law_title")), "doc_id").select(F.lit("law").alias("source_type"), F.col("unit_id").alias("record_id"), F.col("law_title").alias("title"), F.col("canonical_citation").alias("citation"), cut(F.col("text")).alias("text"))
        halves = F.concat(F.lit("Facts: "), cut(F.coalesce("facts_text", F.lit("")), 500), F.lit("\nDecision: "), cut(F.coalesce("decision_text", F.lit("")), 500))
        case = self.table("cases").select(F.lit("case").alias("source_type"), F.col("case_id").alias("record_id"), "title", F.coalesce(non_blank(F.col("case_number")), non_blank(F.col("ecli"))).alias("citation"), halves.alias("text"))
        out = ranked.join(law.unionByName(case), ["source_type", "record_id"])
        if preview:
            return out.withColumn("content_mode", F.lit("preview"))
        children = retrieval.children_in_order(self.table("passages"), "parent_id", "seq", "passage_id", "segment", "text").withColumnsRenamed({"parent_id": "evidence_id", "children": "all_passages"})
        return out.join(children, "evidence_id", "left").withColumn("content_mode", F.lit("full"))

    def catalogue(self) -> DataFrame:
        """Laws with an example citation of each unit kind (Q6)."""
        nested = retrieval.examples(self.table("units"), "doc_id", "unit_type", "local_citation")
        return self.table("laws").join(nested, "doc_id", "left").select("doc_id", "title", "jurisdiction", "examples").orderBy("jurisdiction", "title")

    def extent(self) -> DataFrame:
        """One row: the cases' countries and jurisdictions, and their first and last date (Q6)."""
        named = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit(""))))
        return self.table("cases").agg(named("country").alias("countries"), named("jurisdiction").alias("jurisdictions"), F.min("decided_date").alias("first_date"), F.max("decided_date").alias("last_date"))
