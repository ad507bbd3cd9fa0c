"""Language-model clients for ``judge.call_judge``: a prompt in, text and token counts out.

Transport is a function (url, headers, body) -> (status, body), so tests need no network. A status
that says "later" raises ``Busy``, which the caller tries again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from http.client import HTTPConnection, HTTPSConnection
from urllib.parse import urlsplit

Transport = Callable[[str, dict, bytes], tuple[int, bytes]]


class Busy(OSError):
    """The server asks to come back later."""


def post(url: str, headers: dict, body: bytes, timeout: float = 120.0) -> tuple[int, bytes]:
    """One POST on a connection of its own; any status is an answer, with the body that explains it."""
    parts = urlsplit(url)
    kind = HTTPSConnection if parts.scheme == "https" else HTTPConnection
    connection = kind(parts.hostname, parts.port, timeout=timeout)
    try:
        target = parts.path or "/"
        connection.request("POST", f"{target}?{parts.query}" if parts.query else target, body, headers)
        answer = connection.getresponse()
        return answer.status, answer.read()
    finally:
        connection.close()


@dataclass
class Client:
    """A chat endpoint. ``read`` finds text and token counts in its answer."""

    url: str
    model: str
    headers: dict
    request: Callable[[str, str], dict]
    read: Callable[[dict], dict]
    transport: Transport = post

    def __call__(self, prompt: str) -> dict:
        status, body = self.transport(self.url, {"content-type": "application/json", **self.headers}, json.dumps(self.request(self.model, prompt)).encode())
        if status == 429 or status >= 500:
            raise Busy(f"{status}: {body[:200]!r}")
        if status != 200:
            raise ValueError(f"{status}: {body[:500]!r}")
        return self.read(json.loads(body))


def hosted(url: str, model: str, key: str, max_tokens: int = 8, transport: Transport = post) -> Client:
    """A hosted chat API that takes messages and answers with content parts and usage."""
    return Client(
        url, model, {"x-api-key": key},
        lambda m, p: {"model": m, "max_tokens": max_tokens, "temperature": 0, "messages": [{"role": "user", "content": p}]},
        lambda a: {"text": "".join(x.get("text", "") for x in a["content"]), "input_tokens": a["usage"]["input_tokens"], "output_tokens": a["usage"]["output_tokens"]},
        transport,
    )


def local(url: str, model: str, seed: int = 0, max_tokens: int = 8, transport: Transport = post) -> Client:
    """A local server that generates from one prompt and counts tokens itself."""
    return Client(
        url, model, {},
        lambda m, p: {"model": m, "prompt": p, "stream": False, "options": {"temperature": 0, "seed": seed, "num_predict": max_tokens}},
        lambda a: {"text": a["response"], "input_tokens": a.get("prompt_eval_count"), "output_tokens": a.get("eval_count")},
        transport,
    )
