"""Settings of the two pipelines; defaults, a YAML loader with overrides by section, and checks of what can be named."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any


@dataclass(frozen=True)
class Chunking:
    method: str = "sentence"
    max_chunk_tokens: int = 256
    overlap: int = 32
    separator: str = "\n\n"

    def __post_init__(self):
        if self.method not in ("sentence", "paragraph", "fixed_tokens", "sliding_window"):
            raise ValueError(f"unknown chunking method: {self.method}")
        if self.method == "sliding_window" and self.overlap >= self.max_chunk_tokens:
            raise ValueError("the overlap must be smaller than the window")


@dataclass(frozen=True)
class Cleanup:
    urls: bool = True
    emails: bool = True
    special: bool = False
    whitespace: bool = True
    normalize_unicode: bool = True
    lowercase: bool = False
    dedup: bool = True
    min_chars: int = 10
    max_chars: int = 2048


@dataclass(frozen=True)
class Retrieval:
    method: str = "bm25"
    top_n: int = 10
    k1: float = 1.5
    b: float = 0.75
    alpha: float = 0.5
    idf_floor: bool = True

    def __post_init__(self):
        if self.method not in ("bm25", "embedding", "hybrid"):
            raise ValueError(f"unknown retrieval method: {self.method}")


@dataclass(frozen=True)
class Compression:
    enabled: bool = True
    reduce_ratio: float = 0.7
    token_budget: int = 2048
    granularity: str = "phrase"


@dataclass(frozen=True)
class Packing:
    strategy: str = "round_robin"
    max_tokens: int = 4096
    start_ratio: float = 0.4
    end_ratio: float = 0.3

    def __post_init__(self):
        if self.strategy not in ("round_robin", "edges_first", "decreasing"):
            raise ValueError(f"unknown packing strategy: {self.strategy}")


@dataclass(frozen=True)
class ContextPipeline:
    """Chunk, clean, rank, compress, pack."""

    chunking: Chunking = field(default_factory=Chunking)
    cleanup: Cleanup = field(default_factory=Cleanup)
    retrieval: Retrieval = field(default_factory=Retrieval)
    compression: Compression = field(default_factory=Compression)
    packing: Packing = field(default_factory=Packing)


@dataclass(frozen=True)
class PromptPipeline:
    """Budget, context filter, sentence filter, token pruning, assembly."""

    rate: float = 0.5
    target_token: int = -1
    instruction_rate: float = 1.0
    question_rate: float = 1.0
    context_budget: str = "+100"
    rank_method: str = "llmlingua"
    condition_in_question: str = "none"
    target_context: int = -1
    context_level_rate: float = 1.0
    reorder: str = "original"
    use_sentence_filter: bool = False
    keep_first: int = 0
    keep_last: int = 0
    sentence_bonus: float = 100.0
    token_budget_ratio: float = 1.4
    iterative_size: int = 200
    force_digits: bool = False
    concat_question: bool = True
    add_instruction: bool = False


def overridden(config: Any, sections: dict[str, Any]) -> Any:
    """A copy of a config with values or, for nested sections, dictionaries of values replaced; unknown names raise."""
    known = {f.name for f in fields(config)}
    if unknown := set(sections) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(config, **{k: overridden(getattr(config, k), v) if isinstance(v, dict) else v for k, v in sections.items()})


def load(path: str, overrides: dict[str, Any] | None = None) -> ContextPipeline:
    """Settings of the context pipeline from a YAML file of sections."""
    import yaml

    with open(path) as file:
        return overridden(overridden(ContextPipeline(), yaml.safe_load(file) or {}), overrides or {})
