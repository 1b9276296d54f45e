"""Settings of a search index."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame


@dataclass(frozen=True)
class FieldConfig:
    """A searched field. `extract` computes its text; else it is what lies at `path`, or at the field's own name."""

    weight: float = 1.0
    suggest: bool = True
    path: str | None = None
    extract: Column | Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class TokenizerConfig:
    """`tokenize`, a Column function from text to array<string>, replaces everything else; `normalizer` is applied to the text, `stemmer` to each token."""

    language: str = "en"
    stopwords: Collection[str] | None = None
    tokenize: Callable[[Column], Column] | None = None
    stemmer: Callable[[Column], Column] | None = None
    normalizer: Callable[[Column], Column] | None = None

    def __post_init__(self):
        if self.language not in ("en", "none"):
            raise ValueError(f"language must be 'en' or 'none', not {self.language!r}")


@dataclass(frozen=True)
class FuzzyConfig:
    """`min_length` is accepted and has no effect: words of fewer than four characters are never matched fuzzily."""

    enabled: bool = True
    max_distance: int = 2
    min_length: int = 4

    @property
    def distance(self) -> int:
        return self.max_distance if self.enabled else 0


@dataclass(frozen=True)
class IndexConfig:
    """Everything about an index but its documents. `suggest_case_sensitive` is accepted and has no effect."""

    fields: Mapping[str, FieldConfig]
    id_col: str = "id"
    id_expr: Column | None = None
    fuzzy: FuzzyConfig = field(default_factory=FuzzyConfig)
    tokenizer: TokenizerConfig = field(default_factory=TokenizerConfig)
    k1: float = 1.2
    b: float = 0.75
    suggest_max_results: int = 10
    suggest_case_sensitive: bool = False

    @classmethod
    def of(cls, fields: Collection[str] | Mapping[str, FieldConfig | Mapping], **rest) -> IndexConfig:
        """From names, or from names with their settings."""
        if isinstance(fields, Mapping):
            made = {n: f if isinstance(f, FieldConfig) else FieldConfig(**f) for n, f in fields.items()}
        else:
            made = {n: FieldConfig() for n in fields}
        if not made:
            raise ValueError("an index needs at least one field")
        return cls(made, **rest)

    def to_dict(self) -> dict:
        """What can be written as JSON; columns and functions are left out."""
        return {
            "fields": {n: {"weight": f.weight, "suggest": f.suggest, "path": f.path} for n, f in self.fields.items()},
            "id_col": self.id_col,
            "fuzzy": {"enabled": self.fuzzy.enabled, "max_distance": self.fuzzy.max_distance, "min_length": self.fuzzy.min_length},
            "tokenizer": {"language": self.tokenizer.language, "stopwords": None if self.tokenizer.stopwords is None else sorted(self.tokenizer.stopwords)},
            "k1": self.k1,
            "b": self.b,
            "suggest_max_results": self.suggest_max_results,
        }

    @classmethod
    def from_dict(cls, d: Mapping) -> IndexConfig:
        rest = {k: d[k] for k in ("id_col", "k1", "b", "suggest_max_results") if k in d}
        return cls.of(d["fields"], fuzzy=FuzzyConfig(**d.get("fuzzy", {})), tokenizer=TokenizerConfig(**d.get("tokenizer", {})), **rest)
