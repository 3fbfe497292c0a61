"""Hosted models: their settings, and callables for embedding, reranking and structured answers.

A post function (url, body, headers, timeout) -> dict does the talking; the default one uses the standard library.
"""

from __future__ import annotations

import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, fields
from pathlib import Path

from .functions.json_repair import first_valid, parse_object

Post = Callable[[str, dict, dict, float], dict]


class ModelError(RuntimeError):
    """A model that could not be reached, or gave nothing usable."""


def post_json(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (urllib.error.URLError, TimeoutError, json.JSONDecodeError) as e:
        raise ModelError(f"{url}: {e}") from e


def _setting(name: str, default=None):
    """A field that is read from a setting of this name."""
    return field(default=default, metadata={"name": name})


@dataclass(frozen=True)
class Settings:
    """Settings of the models, by the names under which the environment or a file gives them (fixed values)."""

    llm_url: str = _setting("LLM_BINDING_HOST")
    llm_model: str = _setting("LLM_MODEL")
    llm_key: str = _setting("LLM_BINDING_API_KEY", "not-required")
    llm_timeout: float = _setting("LLM_TIMEOUT", 120.0)
    llm_json_retries: int = _setting("LLM_JSON_RETRIES", 2)
    llm_temperature: float = _setting("OPENAI_LLM_TEMPERATURE", 0.0)
    llm_context_window: int = _setting("LLM_CONTEXT_WINDOW", 60_000)
    planner_max_tokens: int = _setting("PLANNER_MAX_OUTPUT_TOKENS", 2_000)
    grader_max_tokens: int = _setting("GRADER_MAX_OUTPUT_TOKENS", 2_000)
    answer_max_tokens: int = _setting("SYNTHESIZER_MAX_OUTPUT_TOKENS", 8_000)
    embedding_url: str = _setting("EMBEDDING_BINDING_HOST")
    embedding_model: str = _setting("EMBEDDING_MODEL")
    embedding_key: str = _setting("EMBEDDING_BINDING_API_KEY", "not-required")
    embedding_dim: int = _setting("EMBEDDING_DIM")
    embedding_batch: int = _setting("EMBEDDING_BATCH_NUM", 32)
    embedding_chars: int = _setting("EMBEDDING_TOKEN_LIMIT", 8192)
    embedding_send_dim: bool = _setting("EMBEDDING_SEND_DIM", False)
    embedding_timeout: float = _setting("EMBEDDING_TIMEOUT", 120.0)
    rerank_url: str = _setting("RERANK_BINDING_HOST")
    rerank_model: str = _setting("RERANK_MODEL")
    rerank_key: str = _setting("RERANK_BINDING_API_KEY", "not-required")
    rerank_enabled: bool = _setting("RERANK_BY_DEFAULT", True)
    rerank_min_score: float = _setting("MIN_RERANK_SCORE", 0.0)
    rerank_timeout: float = _setting("RERANK_TIMEOUT", 120.0)
    rerank_retries: int = _setting("RERANK_RETRIES", 2)
    evidence_tokens: int = _setting("EVIDENCE_TOKEN_BUDGET", 42_000)
    passage_threshold: int = _setting("PASSAGE_THRESHOLD_TOKENS", 1_600)
    passage_target: int = _setting("PASSAGE_TARGET_TOKENS", 800)
    passage_most: int = _setting("PASSAGE_MAX_TOKENS", 1_000)
    passage_overlap: int = _setting("PASSAGE_OVERLAP_TOKENS", 100)
    token_safety: float = _setting("TOKEN_SAFETY_FACTOR", 1.2)

    def __post_init__(self) -> None:
        if not 0 <= self.passage_overlap < self.passage_target <= self.passage_most < self.passage_threshold:
            raise ValueError("passage limits must satisfy overlap < target <= most < threshold")
        if self.token_safety < 1:
            raise ValueError("TOKEN_SAFETY_FACTOR must be at least 1")
        for f in fields(self):
            value = getattr(self, f.name)
            if "retries" in f.name and not 0 <= value <= 5:
                raise ValueError(f"{f.metadata['name']} must be between 0 and 5")
            if value is None:
                raise ValueError(f"{f.metadata['name']} is not set")
            if isinstance(value, int) and not isinstance(value, bool) and "retries" not in f.name and f.name != "passage_overlap" and value < 1:
                raise ValueError(f"{f.metadata['name']} must be positive")
        if self.evidence_tokens + self.answer_max_tokens > self.llm_context_window - 4_000:
            raise ValueError("the evidence and the answer leave too little room for the prompt")

    @classmethod
    def read(cls, environment: Mapping[str, str] | None = None, file: str | Path | None = None) -> Settings:
        """From the environment, and where it lacks a setting from a file of NAME=value lines."""
        given = dict(_lines(file)) if file is not None and Path(file).exists() else {}
        given |= {k: v for k, v in (os.environ if environment is None else environment).items()}
        return cls(**{f.name: _typed(f.metadata["name"], given[f.metadata["name"]].strip(), str(f.type)) for f in fields(cls) if given.get(f.metadata["name"], "").strip()})


def _lines(file: str | Path):
    for line in Path(file).read_text(encoding="utf-8").splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            yield name.strip(), value.strip().strip("\"'")


def _typed(name: str, value: str, kind: str):
    try:
        if kind == "bool":
            return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[value.lower()]
        return {"int": int, "float": float}.get(kind, str)(value)
    except (KeyError, ValueError) as e:
        raise ValueError(f"{name} is {value!r}") from e


def bounded_text(text: str, limit: int, marker: str = "\n[…]\n") -> str:
    """At most so many characters, two thirds of them from the head (P5)."""
    room = max(limit - len(marker), 0)
    return text if len(text) <= limit else text[: room * 2 // 3] + marker + text[len(text) - (room - room * 2 // 3) :] if room else text[:limit]


def embedder(s: Settings, post: Post = post_json) -> Callable[[list[str]], list[list[float]]]:
    """Unit vectors of texts, asked for in batches, in the order of the texts; another number or width is an error."""

    def embed(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), s.embedding_batch):
            some = [bounded_text(t, s.embedding_chars) for t in texts[a : a + s.embedding_batch]]
            body = {"model": s.embedding_model, "input": some, **({"dimensions": s.embedding_dim} if s.embedding_send_dim else {})}
            rows = sorted(post(f"{s.embedding_url.rstrip('/')}/embeddings", body, {"Authorization": f"Bearer {s.embedding_key}"}, s.embedding_timeout)["data"], key=lambda r: r["index"])
            if len(rows) != len(some) or any(len(r["embedding"]) != s.embedding_dim for r in rows):
                raise ModelError("the embeddings have another number or width")
            for r in rows:
                norm = max(math.sqrt(sum(x * x for x in r["embedding"])), 1e-12)
                out.append([x / norm for x in r["embedding"]])
        return out

    return embed


def reranker(s: Settings, post: Post = post_json) -> Callable[[str, list[str]], list[float]] | None:
    """A score for each text by a reranking service, tried some times; a place out of range is an error, a text without a score has minus infinity. None if reranking is off."""
    if not s.rerank_enabled:
        return None

    def score(query: str, texts: list[str]) -> list[float]:
        body = {"model": s.rerank_model, "query": query, "documents": texts, "top_n": len(texts), "return_documents": False}
        problem: Exception | None = None
        for _ in range(s.rerank_retries + 1):
            try:
                out = [-math.inf] * len(texts)
                for r in post(s.rerank_url, body, {"Authorization": f"Bearer {s.rerank_key}"}, s.rerank_timeout).get("results") or []:
                    if not 0 <= int(r["index"]) < len(texts):
                        raise ValueError(f"the reranker named place {r['index']}")
                    out[int(r["index"])] = float(r.get("relevance_score") or 0.0)
                return out
            except (ModelError, KeyError, TypeError, ValueError, AttributeError) as e:
                problem = e
        raise ModelError(f"the reranker failed {s.rerank_retries + 1} times") from problem

    return score


@dataclass
class JsonModel:
    """A chat model that is asked for one JSON object, and asked again with what was wrong (L1)."""

    settings: Settings
    post: Post = post_json

    def ask(self, system: str, data: Mapping, max_tokens: int, valid: Callable[[Mapping], object] = dict) -> object:
        """What `valid` makes of the answer's first mapping that it accepts."""
        s = self.settings
        start = [{"role": "system", "content": system}, {"role": "user", "content": json.dumps(data, ensure_ascii=False)}]
        said, wrong = "", ""
        for attempt in range(s.llm_json_retries + 1):
            more = [{"role": "assistant", "content": bounded_text(said, 8_000)}, {"role": "user", "content": f"{wrong} Answer again with exactly one complete JSON object of the requested form and nothing else."}] if attempt else []
            body = {"model": s.llm_model, "messages": start + more, "temperature": s.llm_temperature, "max_tokens": max_tokens, "response_format": {"type": "json_object"}}
            choice = self._choice(body)
            said = choice.get("message", {}).get("content") or ""
            if choice.get("finish_reason") == "length":
                wrong = "The answer was cut off at the limit of tokens; make it shorter."
                continue
            try:
                return first_valid(parse_object(said), valid)
            except (TypeError, ValueError, KeyError) as e:
                wrong = f"The answer was not valid: {e}."
        raise ModelError(f"no valid answer in {s.llm_json_retries + 1} attempts: {wrong}")

    def _choice(self, body: dict) -> dict:
        send = lambda b: self.post(f"{self.settings.llm_url.rstrip('/')}/chat/completions", b, {"Authorization": f"Bearer {self.settings.llm_key}"}, self.settings.llm_timeout)["choices"][0]
        try:
            return send(body)
        except ModelError:  # some servers know no response format
            return send({k: v for k, v in body.items() if k != "response_format"})


def loop(settings: Settings, catalogue: Mapping, retrieve: Callable, pack: Callable, prompts: Sequence[str], *, most: int = 1, post: Post = post_json):
    """The bounded loop with a hosted model as planner, grader and writer (Q11); prompts are the three system texts."""
    from .operators.agent import Loop, Plan

    model, (plan, grade, answer) = JsonModel(settings, post), prompts
    shown = lambda p: p.__dict__ if p is not None else None
    return Loop(
        plan=lambda request, before, gaps: model.ask(plan, {"user_request": request, "corpus_catalog": dict(catalogue), "previous_plan": shown(before), "evidence_gaps": gaps}, settings.planner_max_tokens, lambda m: (Plan.of(m), dict(m))[1]),
        retrieve=retrieve,
        pack=pack,
        grade=lambda request, p, packed: model.ask(grade, {"user_request": request, "plan": shown(p), "evidence": packed}, settings.grader_max_tokens),
        answer=lambda request, p, packed: model.ask(answer, {"user_request": request, "task": p.task, "evidence": packed}, settings.answer_max_tokens),
        most=most,
    )
