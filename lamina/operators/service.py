"""Calls to HTTP services that may be busy for a while."""

from __future__ import annotations

import http.client
import json
import time
import urllib.error
import urllib.request


def post(url: str, body: dict, key: str | None = None, timeout: float = 60.0, tries: int = 4, pause: float = 1.0) -> dict:
    """A service's JSON answer; what may pass (no connection, a broken one, 429, 5xx) is tried again after a pause that doubles."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    for n in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), head), timeout=timeout) as answer:
                return json.load(answer)
        except (OSError, http.client.HTTPException) as e:
            lasting = isinstance(e, urllib.error.HTTPError) and e.code != 429 and e.code < 500
            if lasting or n + 1 == tries:
                raise
            time.sleep(pause * 2**n)
    raise ValueError("tries must be positive")
