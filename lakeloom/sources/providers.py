"""Providers of model replies over HTTP, as functions (system, prompt) -> text for call_provider()."""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from lakeloom.operators.instruct import Options, ollama_payload, openai_payload, read_ndjson

#: send(url, payload, headers) -> the reply's lines
Send = Callable[[str, dict, dict], Iterable[str]]


def send_http(url: str, payload: dict, headers: dict) -> Iterator[str]:
    """Posts JSON and yields the lines of the reply."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request) as reply:
        for line in reply:
            yield line.decode()


@dataclass(frozen=True)
class Provider:
    """Endpoints of one kind, "ollama" or "openai"; called with an endpoint's number it gives the function that asks this endpoint.

    An endpoint of the first kind that cannot be reached gives an empty reply and a line on the standard error; with the second an error is an error.
    """

    kind: str
    model: str
    urls: tuple[str, ...]
    options: Options | None = None
    output_format: dict | str | None = None
    think: bool | None = None
    headers: dict = field(default_factory=dict)
    send: Send = send_http

    def __post_init__(self):
        if self.kind not in ("ollama", "openai"):
            raise ValueError(f"unknown provider: {self.kind}")

    def __call__(self, endpoint: int) -> Callable[[str, str], str]:
        url = self.urls[endpoint % len(self.urls)]

        def ask(system: str, prompt: str) -> str:
            said = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
            if self.kind == "openai":
                reply = json.loads("".join(self.send(url, openai_payload(said, self.model, self.options, self.output_format), self.headers)))
                return "".join(c.get("text", "") for item in reply.get("output", []) for c in item.get("content") or [])
            try:
                return read_ndjson(iter(self.send(url, ollama_payload(said, self.model, self.options, self.output_format, self.think), self.headers)))
            except (urllib.error.URLError, OSError) as e:
                print(f"no reply from {url}: {e}", file=sys.stderr)
                return ""

        return ask
