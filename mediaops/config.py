"""Settings passed to operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """``key`` signs requests (None: signatures are not asked for); ``cache_capacity_gb`` is the size
    above which stale renditions are removed."""

    key: str | None = None
    avif_enable: bool = False
    cache_enable: bool = True
    cache_capacity_gb: float = 10.0
    retention: str = "7 days"
