"""Settings, passed explicitly to the plan builders; there is no global state."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class RetrievalConfig:
    """Retrieval and generation settings.

    Frozen, so a changed setting is a new object and an index built for the old
    one cannot be taken for the new one by accident (see ``index_key``).
    """

    top_k: int = 3
    min_score: float = 0.1
    max_features: int = 5000
    provider: str = "offline"
    temperature: float = 0.3
    max_tokens: int = 1024

    def __post_init__(self):
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.max_features < 1:
            raise ValueError("max_features must be at least 1")
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must lie in [0, 1]")

    def updated(self, **changes) -> "RetrievalConfig":
        """A copy with the settings that are not None replaced."""
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    def index_key(self, source: str) -> str:
        """Names the index of one input; only settings the index depends on count."""
        return f"{source}-features-{self.max_features}"


@dataclass(frozen=True)
class ClassifierConfig:
    """Term, vocabulary and SVM settings of the intent classifier.

    Training runs until the gradient has fallen to ``tolerance`` times the first one, for
    ``max_iter`` steps at most; a class that reaches the limit is warned of.
    """

    max_features: int = 5000
    min_df: int = 1
    max_df: float = 0.95
    c: float = 1.0
    tolerance: float = 1e-4
    max_iter: int = 10_000
    train_fraction: float = 0.8
    seed: int = 42
