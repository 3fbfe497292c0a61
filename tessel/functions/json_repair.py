"""JSON objects out of model answers."""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Callable, Mapping

_FENCE = re.compile(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$")


def parse_object(text: str) -> dict:
    """The outermost object of an answer: fences and trailing commas are forgiven, a cut-off object is an error.

    An object inside a broken one is never taken for the answer.
    """
    plain = _FENCE.sub("", text.strip()).strip()
    start = plain.find("{")
    if start < 0:
        raise ValueError("the answer holds no JSON object")
    end = plain.rfind("}")
    body = plain[start : end + 1] if end > start else plain[start:]
    for attempt in (body, re.sub(r",(\s*[}\]])", r"\1", body)):
        try:
            found = json.loads(attempt)
            break
        except json.JSONDecodeError:
            continue
    else:
        try:
            found, _ = json.JSONDecoder().raw_decode(plain, start)
        except json.JSONDecodeError as error:
            raise ValueError(f"the answer's JSON is broken: {error}") from error
    if not isinstance(found, dict):
        raise ValueError("the answer's JSON is no object")
    return found


def first_valid(payload: object, validate: Callable[[Mapping], object]) -> object:
    """The result for the first mapping, breadth first, that a validator accepts."""
    queue, problem = deque([payload]), None
    while queue:
        item = queue.popleft()
        if isinstance(item, Mapping):
            try:
                return validate(item)
            except (ValueError, KeyError, TypeError) as error:
                problem = problem or error
            queue.extend(item.values())
        elif isinstance(item, (list, tuple)):
            queue.extend(item)
    raise problem or ValueError("the answer holds no mapping")
