"""Suppression of repeated alerts: a kept alert decides about later ones, so each key is folded in time order (`carry`).

Rows of a key at one moment are ordered by id. A task holds the state of one key: an expiry, the last signatures, or the
times within one span.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import OTHER_TTL, SERVER_TTL
from .carry import fold

KEPT = {"kept": "boolean"}


def ttl_step(state: list, us: int, span: int) -> tuple[bool]:
    """Whether an event stays: one that stays suppresses those up to and at its expiry; suppressed ones extend nothing."""
    stays = not state or state[0] < us
    if stays:
        state[:] = [us + span]
    return (stays,)


def ttl_kept(times: Sequence[int], spans: Sequence[int]) -> list[bool]:
    state: list[int] = []
    return [ttl_step(state, t, span)[0] for t, span in zip(times, spans, strict=True)]


def ttl_dedup(alerts: DataFrame, signature: str = "signature", ttl: Mapping[str, int] = SERVER_TTL) -> DataFrame:
    """Adds kept: alerts of a signature outside the time to live (seconds by severity) of the last kept one."""
    step = lambda state, us, severity: ttl_step(state, us, 1_000_000 * ttl.get(severity, OTHER_TTL))
    return fold(alerts, [signature], ["us", "severity"], list, step, KEPT)


def recent_dedup(alerts: DataFrame, signature: str = "signature", key: str = "client_id", last: int = 10) -> DataFrame:
    """Adds kept: alerts whose signature isn't among the client's last kept ones."""

    def step(recent: deque, s: str) -> tuple[bool]:
        if s in recent:
            return (False,)
        recent.append(s)
        return (True,)

    return fold(alerts, [key], [signature], lambda: deque(maxlen=last), step, KEPT)


def rate_limit(df: DataFrame, n: int = 50, span: int = 60_000_000, key: str = "client_id") -> DataFrame:
    """Adds kept: at most n kept rows of a key in any trailing span; only kept rows count."""

    def step(times: deque, us: int) -> tuple[bool]:
        while times and times[0] <= us - span:
            times.popleft()
        stays = len(times) < n
        if stays:
            times.append(us)
        return (stays,)

    return fold(df, [key], ["us"], deque, step, KEPT)


def signature(*parts: Column, features: Column | None = None, first: int = 3) -> Column:
    """client_category_severity and the first features, sorted."""
    names = [F.array_join(F.array_sort(F.slice(features, 1, first)), ",")] if features is not None else []
    return F.concat_ws("_", *parts, *names)
