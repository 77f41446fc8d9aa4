"""A model behind an HTTP endpoint with the usual chat and embedding paths. Tasks get a copy of it; the key comes from the environment."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Any

from weftwork.errors import MissingKey, WeftError

KEY, URL = "WEFTWORK_API_KEY", "WEFTWORK_API_URL"


def keys_of(path: str) -> dict[str, str]:
    """NAME=value lines of a .env file; remarks and blank lines don't count."""
    out = {}
    try:
        with open(path, encoding="utf-8") as file:
            for line in file:
                name, sep, value = line.strip().removeprefix("export ").partition("=")
                if sep and not name.startswith("#"):
                    out[name.strip()] = value.strip().strip("\"'")
    except FileNotFoundError:
        pass
    return out


@dataclass
class HttpClient:
    """Retries what may pass (429, 5xx, time-outs), with waits that double; other refusals end the call."""

    url: str | None = None
    key: str | None = None
    model: str = "default"
    embed_model: str = "default-embed"
    tries: int = 3
    wait: float = 1.5
    timeout: float = 60.0
    batch: int = 64

    def __post_init__(self) -> None:
        found = keys_of(".env") | dict(os.environ)
        self.key, self.url = self.key or found.get(KEY), self.url or found.get(URL)
        if not self.key or not self.url:
            raise MissingKey(f"set {KEY} and {URL}, or replay a cassette, or plan with --dry-run")

    def _post(self, path: str, body: dict) -> Any:
        request = urllib.request.Request(f"{str(self.url).rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                    return json.load(reply)
            except urllib.error.HTTPError as e:
                if e.code != 429 and e.code < 500:
                    raise WeftError(f"{path}: {e.code} {e.reason}") from e
                error: Exception = e
            except (urllib.error.URLError, TimeoutError) as e:
                error = e
            if attempt + 1 < self.tries:
                time.sleep(self.wait * 2**attempt)
        raise WeftError(f"{path} failed {self.tries} times: {error}")

    def chat(self, prompt: str, system: str | None = None, temperature: float = 0.7, max_tokens: int = 1024) -> str:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        got = self._post("chat/completions", {"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens})
        return got["choices"][0]["message"]["content"] or ""

    def embed(self, texts: list[str], input_type: str = "passage") -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            got = self._post("embeddings", {"model": self.embed_model, "input": texts[at : at + self.batch], "input_type": input_type})
            out += [x["embedding"] for x in sorted(got["data"], key=lambda x: x["index"])]
        return out
