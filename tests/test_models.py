import json
import threading
import urllib.error
import urllib.request

import pytest

from tessel import models as M
from tessel.service import checked_request, server

GIVEN = {"LLM_BINDING_HOST": "http://l", "LLM_MODEL": "m", "EMBEDDING_BINDING_HOST": "http://e/", "EMBEDDING_MODEL": "e", "EMBEDDING_DIM": "2", "EMBEDDING_BATCH_NUM": "2", "RERANK_BINDING_HOST": "http://r", "RERANK_MODEL": "r", "EMBEDDING_TOKEN_LIMIT": "20"}


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# x\nexport LLM_TIMEOUT='7'\nLLM_MODEL=other\nRERANK_BY_DEFAULT=off\n")
    s = M.Settings.read(GIVEN, tmp_path / "env")
    assert (s.llm_model, s.llm_timeout, s.rerank_enabled, s.embedding_dim, s.llm_key) == ("m", 7.0, False, 2, "not-required")
    for wrong in ({"LLM_MODEL": " "}, {"EMBEDDING_DIM": "x"}, {"EMBEDDING_DIM": "0"}, {"LLM_JSON_RETRIES": "6"}, {"PASSAGE_TARGET_TOKENS": "100"}, {"TOKEN_SAFETY_FACTOR": "0.9"}, {"EVIDENCE_TOKEN_BUDGET": "50000"}, {"RERANK_BY_DEFAULT": "maybe"}):
        with pytest.raises(ValueError):
            M.Settings.read({**GIVEN, **wrong})
    assert M.Settings.read({**GIVEN, "LLM_JSON_RETRIES": "0", "PASSAGE_OVERLAP_TOKENS": "0"}).llm_json_retries == 0


def test_embedder():
    asked = []

    def post(url, body, headers, timeout):
        asked.append((url, body["input"]))
        return {"data": [{"index": i, "embedding": [3.0, 4.0 * (i + 1)]} for i in reversed(range(len(body["input"])))]}

    out = M.embedder(M.Settings.read(GIVEN), post)(["a", "b", "x" * 50])
    assert out[0] == [0.6, 0.8] and len(out) == 3 and [len(x[1]) for x in asked] == [2, 1] and len(asked[1][1][0]) == 20 and asked[0][0] == "http://e/embeddings"
    with pytest.raises(M.ModelError):
        M.embedder(M.Settings.read(GIVEN), lambda *a: {"data": []})(["a"])


def test_reranker():
    tries = []

    def post(url, body, headers, timeout):
        tries.append(1)
        if len(tries) == 1:
            raise M.ModelError("no")
        return {"results": [{"index": 1, "relevance_score": 0.5}]}

    s = M.Settings.read(GIVEN)
    assert M.reranker(s, post)("q", ["a", "b"]) == [-float("inf"), 0.5] and len(tries) == 2
    with pytest.raises(M.ModelError):
        M.reranker(s, lambda *a: {"results": [{"index": 9}]})("q", ["a"])
    assert M.reranker(M.Settings.read({**GIVEN, "RERANK_BY_DEFAULT": "0"})) is None


def test_json_model_asks_again():
    answers = [{"finish_reason": "length", "message": {"content": "{"}}, {"message": {"content": "none"}}, {"message": {"content": '```json\n{"x": {"task": "t"}}\n```'}}]
    sent = []

    def post(url, body, headers, timeout):
        if "response_format" in body and not sent:
            sent.append(None)
            raise M.ModelError("no such field")
        sent.append(body)
        return {"choices": [answers[len([b for b in sent if b]) - 1]]}

    model = M.JsonModel(M.Settings.read(GIVEN), post)
    assert model.ask("system", {"a": 1}, 10, lambda m: m["task"]) == "t"
    assert "response_format" not in sent[1] and "shorter" in sent[2]["messages"][-1]["content"] and "not valid" in sent[3]["messages"][-1]["content"]
    with pytest.raises(M.ModelError):
        M.JsonModel(M.Settings.read(GIVEN), lambda *a: {"choices": [{"message": {"content": "[]"}}]}).ask("s", {}, 1)


def test_loop_with_a_hosted_model():
    said = iter([{"task": "compare", "queries": ["q"]}, {"status": "sufficient", "sufficient": True}, {"answer": "a", "findings": [{"statement": "s", "evidence_ids": ["law_unit:1", "x"]}]}])
    post = lambda *a: {"choices": [{"message": {"content": json.dumps(next(said))}}]}
    out = M.loop(M.Settings.read(GIVEN), {}, lambda plan, k: [1], lambda items, expanded: [{"evidence_id": "law_unit:1"}], ("p", "g", "a"), post=post).run("ask", 5)
    assert out["findings"] == [{"statement": "s", "evidence_ids": ["law_unit:1"]}] and out["task"] == "compare"


def test_requests():
    assert checked_request({"question": " q "}) == {"question": "q", "top_k": 10, "response_language": "zh-CN", "reference_only": False}
    for wrong in ([], {}, {"question": " "}, {"question": "q", "top_k": 0}, {"question": "q", "top_k": True}, {"question": "q", "x": 1}, {"question": "q", "reference_only": 1}, {"question": "q", "response_language": ""}, {"question": "x" * 50_001}):
        with pytest.raises(ValueError):
            checked_request(wrong)


def test_service():
    started, release = threading.Event(), threading.Event()

    def answer(request):
        if request["question"] == "wait":
            started.set()
            release.wait(10)
        if request["question"] == "upstream":
            raise M.ModelError("secret")
        if request["question"] == "broken":
            raise KeyError("secret")
        return {"evidence": [request["top_k"]]}

    own = server(answer, "127.0.0.1", 0, index="/a/b/index", most_at_once=1)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{own.server_address[1]}"

    def ask(path, body=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, None if body is None else json.dumps(body).encode()), timeout=10) as r:
                return r.status, json.loads(r.read()), r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    try:
        assert ask("/health")[1] == {"status": "ok", "service": "tessel", "index": "index", "max_replans": 1, "max_concurrency": 1}
        assert ask("/query", {"question": "q", "top_k": 3})[:2] == (200, {"evidence": [3]})
        assert [ask(*x)[0] for x in (("/no",), ("/no", {}), ("/query", {"question": ""}), ("/query", {"question": "upstream"}), ("/query", {"question": "broken"}))] == [404, 404, 422, 502, 500]
        assert "secret" not in str(ask("/query", {"question": "broken"})[1])
        waiting = threading.Thread(target=ask, args=("/query", {"question": "wait"}))
        waiting.start()
        assert started.wait(10)
        busy = ask("/query", {"question": "q"})
        assert busy[0] == 503 and busy[2]["Retry-After"] == "1"
        release.set()
        waiting.join(10)
        assert ask("/query", {"question": "q"})[0] == 200
    finally:
        release.set()
        own.shutdown()
        own.server_close()
    with pytest.raises(ValueError):
        server(answer, "127.0.0.1", 0, most_replans=4)
