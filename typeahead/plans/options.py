"""Knobs and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import InvalidInputError


@dataclass(frozen=True)
class BuildOptions:
    min_word_chars: int = 3
    max_edit_distance: int = 2
    fuzzy_prefix_chars: int = 7


@dataclass(frozen=True)
class IndexOptions:
    popularity_weight: float = 0.4
    short_query_chars: int = 3
    short_query_limit: int = 100
    max_score: float | None = None


@dataclass(frozen=True)
class SearchOptions:
    limit: int = 10
    contexts: tuple[str, ...] = ()
    overfetch: int = 2
    ignore_missing_layers: bool = False


@dataclass(frozen=True)
class HybridOptions:
    """How lexical and semantic hits are fused: ``rrf``, ``weighted`` or ``lexical_first``."""

    fusion: str = "rrf"
    k: float = 60.0
    weight: float = 0.5
    candidates: int | None = None

    def __post_init__(self) -> None:
        if self.fusion not in ("rrf", "weighted", "lexical_first"):
            raise InvalidInputError(f"unknown fusion {self.fusion!r}")
        if not 0 <= self.weight <= 1:
            raise InvalidInputError("weight must be between 0 and 1")
        if not self.k > 0:
            raise InvalidInputError("k must be positive")

    def fetch(self, limit: int) -> int:
        return max(self.candidates or max(2 * limit, 20), limit)


@dataclass(frozen=True)
class CompactionPolicy:
    fanout: int = 4
    max_segments: int = 16
    max_hidden_fraction: float = 0.25


@dataclass(frozen=True)
class CleanupPolicy:
    keep_versions: int = 10
    older_than_seconds: float = 3600.0


@dataclass(frozen=True)
class ConnectOptions:
    sync_seconds: float | None = None
    tags: dict[str, str] = field(default_factory=dict)
