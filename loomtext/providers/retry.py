"""Repeating of requests that fail for the moment."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from loomtext.errors import HttpError

TRANSIENT = frozenset((408, 425, 429, 500, 502, 503, 504))


class TransportError(Exception):
    """The request had no answer at all."""


@dataclass
class Policy:
    """Delays grow by ``factor`` with some jitter; a Retry-After in whole seconds goes before them."""

    first: float = 0.5
    factor: float = 2.0
    jitter: float = 0.3
    longest: float = 30.0
    total: float = 90.0
    longest_asked: float = 60.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    random: Callable[[], float] = field(default=random.random)


def asked_delay(header: str | None, policy: Policy) -> float | None:
    return min(float(header.strip()), policy.longest_asked) if header is not None and header.strip().isdigit() else None


def run(send: Callable[[], tuple[int, dict[str, str], bytes]], policy: Policy | None = None) -> bytes:
    """Body of the first answer in the 200s. ``send`` returns status, headers (lower-case names) and body."""
    p = policy or Policy()
    began, delay = p.clock(), p.first
    while True:
        wait = None
        try:
            status, headers, body = send()
            if 200 <= status < 300:
                return body
            what = f"status {status}"
            if status not in TRANSIENT:
                raise HttpError(f"{what}: {body[:200].decode('utf-8', 'replace')}")
            wait = asked_delay(headers.get("retry-after"), p)
        except TransportError as e:
            what = f"no answer: {e}"
        if wait is None:
            wait = min(delay * (1 + p.jitter * (2 * p.random() - 1)), p.longest)
            delay = min(delay * p.factor, p.longest)
        if p.clock() - began + wait > p.total:
            raise HttpError(f"given up: {what}")
        p.sleep(wait)
