"""Full-text search and faceted analytics on Spark."""

from lodestone.config import FieldConfig, FuzzyConfig, IndexConfig, TokenizerConfig
from lodestone.plans.index import SearchIndex
from lodestone.plans.manager import IndexManager

__all__ = ["FieldConfig", "FuzzyConfig", "IndexConfig", "IndexManager", "SearchIndex", "TokenizerConfig"]
