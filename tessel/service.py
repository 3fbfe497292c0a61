"""An HTTP service around an answerer: GET /health and POST /query."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Callable, Mapping
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .models import ModelError

LOG = logging.getLogger(__name__)
#: Fixed limits of a request.
MOST_CHARS, MOST_RESULTS, DEFAULT_LANGUAGE = 50_000, 50, "zh-CN"


def checked_request(raw: object) -> dict:
    """question, top_k, response_language and reference_only of a body; anything else in it is an error."""
    if not isinstance(raw, Mapping):
        raise ValueError("the body must be an object")
    if odd := sorted(set(raw) - {"question", "top_k", "response_language", "reference_only"}):
        raise ValueError(f"unknown fields: {', '.join(odd)}")
    question, language = raw.get("question"), raw.get("response_language", DEFAULT_LANGUAGE)
    top_k, only = raw.get("top_k", 10), raw.get("reference_only", False)
    if not isinstance(question, str) or not question.strip() or len(question) > MOST_CHARS:
        raise ValueError("question must be a text that is not blank")
    if not isinstance(language, str) or not language.strip() or len(language) > 64:
        raise ValueError("response_language must be a text that is not blank")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= MOST_RESULTS:
        raise ValueError(f"top_k must be between 1 and {MOST_RESULTS}")
    if not isinstance(only, bool):
        raise ValueError("reference_only must be true or false")
    return {"question": question.strip(), "top_k": top_k, "response_language": language.strip(), "reference_only": only}


def server(answer: Callable[[dict], Mapping], host: str, port: int, *, index: str = "", most_replans: int = 1, most_at_once: int = 2) -> ThreadingHTTPServer:
    """A server that is not started yet. At most `most_at_once` requests are answered at a time; more get 503 and may come again in a second.

    A model's failure is 502 and any other 500; what went wrong is logged and not told.
    """
    if not 0 <= most_replans <= 3 or most_at_once < 1:
        raise ValueError("0 to 3 further rounds and at least one request at a time")
    slots = threading.BoundedSemaphore(most_at_once)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: Mapping, **headers: str) -> None:
            raw = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            for name, value in {"Content-Type": "application/json; charset=utf-8", "Content-Length": str(len(raw)), **{k.replace("_", "-"): v for k, v in headers.items()}}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:
            if self.path == "/health":
                self.reply(200, {"status": "ok", "service": "tessel", "index": index.rstrip("/").rsplit("/", 1)[-1], "max_replans": most_replans, "max_concurrency": most_at_once})
            else:
                self.reply(404, {"code": "not_found", "message": "There is no such path."})

        def do_POST(self) -> None:
            if self.path != "/query":
                return self.reply(404, {"code": "not_found", "message": "There is no such path."})
            try:
                request = checked_request(json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0))))
            except ValueError as e:
                return self.reply(422, {"code": "invalid_request", "message": str(e)})
            if not slots.acquire(blocking=False):
                return self.reply(503, {"code": "service_busy", "message": "The service is at its limit of requests."}, Retry_After="1")
            try:
                found = answer(request)
            except ModelError:
                LOG.exception("a model failed")
                return self.reply(502, {"code": "upstream_failure", "message": "A model failed."})
            except Exception:
                LOG.exception("a request failed")
                return self.reply(500, {"code": "internal_error", "message": "The request failed."})
            finally:
                slots.release()
            self.reply(200, found)

        def log_message(self, *args) -> None:
            LOG.info(*args)

    return ThreadingHTTPServer((host, port), Handler)
