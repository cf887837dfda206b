"""Registry answers over HTTP, for deployments that have a network; tables need none of this.

Requests are rows (url, host); each host is asked by one task, with a pause between requests,
so its limits hold however large the cluster. An answer that could not be had is
'unavailable', never a miss.
"""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

RETRY = (429, 500, 502, 503, 504)
OUT = "url string, status string, code int, body string"


def contact() -> str:
    """The contact address for registries that ask for one, from the environment only."""
    return os.environ.get("CITELOOM_CONTACT", "")


def _open(url: str, timeout: float, headers: dict[str, str]) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
        return answer.read().decode("utf-8", "replace")


#: The patience of audits, and that of looking one title up: seconds, attempts, and how long to wait after the n-th.
AUDIT = {"timeout": 12, "attempts": 2, "longest_wait": 3, "step": 1}
LOOK_UP = {"timeout": 60, "attempts": 4, "longest_wait": 60, "step": 3}


def get(url: str, timeout: float = 12, attempts: int = 2, longest_wait: float = 3, step: float = 1, fetch: Callable = _open, sleep: Callable = time.sleep, headers: dict[str, str] | None = None) -> tuple[str, int | None, str | None]:
    """(status, code, body). 404 and other refusals that repeating won't change are answers: a miss or 'refused'."""
    code = None
    for attempt in range(attempts):
        wait = min(longest_wait, step * (attempt + 1))
        try:
            return "hit", 200, fetch(url, timeout, headers or {})
        except urllib.error.HTTPError as e:
            code = e.code
            if code not in RETRY:
                return ("miss" if code == 404 else "malformed" if code == 400 else "unavailable"), code, None
            asked = (e.headers or {}).get("Retry-After", "")
            wait = min(longest_wait, float(asked)) if asked.isdigit() else wait
        except (urllib.error.URLError, TimeoutError, OSError):
            code = None
        if attempt + 1 < attempts:
            sleep(wait)
    return "unavailable", code, None


def fetch_all(requests: DataFrame, pause: float = 0.2, patience: dict = AUDIT, fetch: Callable = _open, headers: Callable[[str], dict[str, str]] | None = None) -> DataFrame:
    """Answers to (host, url), each distinct url once; headers(host) are those a host is sent.

    A host is one task's, in which answers are handed on as they come. Store the result: what is read twice is asked twice.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for host, url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if host == last:
                    time.sleep(pause)
                last = host
                row = (url, *get(url, **patience, fetch=fetch, headers=headers(host) if headers else None))
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["url", "status", "code", "body"])

    return requests.select("host", "url").distinct().repartition("host").sortWithinPartitions("host", "url").mapInArrow(ask, OUT)
