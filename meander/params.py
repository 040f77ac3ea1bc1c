"""Settings of a run, with their defaults and the checks on them."""

from __future__ import annotations

from dataclasses import dataclass, replace

SEPARATOR = "\u0001"


@dataclass(frozen=True)
class Params:
    """All settings of a run.  Paths may be any URI Spark can read or write."""

    input: str | None = None
    output: str | None = None
    feat_path1: str | None = None
    feat_path2: str | None = None
    feat_walk_path: str | None = None
    node_path: str | None = None
    node2id_path: str | None = None
    lists_path: str | None = None
    resume_path: str | None = None
    rejects_path: str | None = None
    starts_path: str | None = None
    sinks_path: str | None = None

    walk_length: int = 80
    num_walks: int = 10
    p: float = 1.0
    q: float = 1.0
    degree: int = 50
    directed: bool = False
    weighted: bool = True
    indexed: bool = False
    method: str = "alias"
    half_indexed: bool = False
    vectors: str = "ids"
    index_format: str = "parquet"
    walks_per_task: int = 1_000_000

    dim: int = 128
    window: int = 10
    lr: float = 0.025
    iterations: int = 10
    train_partitions: int | None = None
    min_count: int = 0

    seed: int = 42
    checkpoint_every: int = 8
    num_partitions: int | None = None
    sep: str = SEPARATOR

    def __post_init__(self):
        for name in ("num_walks", "degree", "dim", "window", "iterations", "checkpoint_every", "walks_per_task"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1, got {getattr(self, name)}")
        for name in ("p", "q", "lr"):
            if not getattr(self, name) > 0:
                raise ValueError(f"{name} must be above 0, got {getattr(self, name)}")
        for name in ("walk_length", "min_count"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative, got {getattr(self, name)}")
        for name in ("num_partitions", "train_partitions"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name, known in (("method", ("sums", "alias")), ("vectors", ("ids", "features")), ("index_format", ("parquet", "text"))):
            if getattr(self, name) not in known:
                raise ValueError(f"{name} must be one of {', '.join(known)}, got {getattr(self, name)!r}")
        if not self.sep or any(ch.isspace() for ch in self.sep):
            raise ValueError("sep must be a non-empty string without whitespace")

    def require(self, *names: str) -> None:
        """Raise unless every named path is set."""
        missing = [n for n in names if not getattr(self, n)]
        if missing:
            raise ValueError("these settings are needed here: " + ", ".join(missing))

    def but(self, **changes) -> "Params":
        return replace(self, **changes)
