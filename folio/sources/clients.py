"""A model client over HTTP for ``extraction.generate`` and verdicts, with the standard library only."""

from __future__ import annotations

import json
import os
from urllib.error import HTTPError
from urllib.request import Request, urlopen

from ..operators.extraction import ClientError


class ChatClient:
    """Posts chat messages to ``url``. The answer is ``choices[0].message.content`` or ``message.content``, as servers
    of either form give it. ``key_variable`` names the environment variable with the bearer token, if one is needed."""

    def __init__(self, url: str, model: str, timeout_s: float = 60.0, key_variable: str | None = None, **options):
        self.url, self.model, self.timeout_s, self.key_variable, self.options = url, model, timeout_s, key_variable, options

    def generate(self, *, system_prompt: str, user_prompt: str) -> str:
        messages = [{"role": "system", "content": system_prompt}, {"role": "user", "content": user_prompt}]
        body = json.dumps({"model": self.model, "messages": messages, "stream": False, **self.options}).encode()
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        try:
            with urlopen(Request(self.url, body, headers), timeout=self.timeout_s) as answer:
                found = json.load(answer)
            message = found["choices"][0]["message"] if found.get("choices") else found["message"]
            return message["content"] or ""
        except HTTPError as e:
            raise ClientError(f"HTTP {e.code}", e.code) from e
        except (OSError, ValueError, LookupError, TypeError) as e:
            raise ClientError(f"{type(e).__name__}: {e}") from e
