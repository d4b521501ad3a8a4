"""The annotated matrix: rows with annotations and features, and what belongs to it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Profile:
    """Immutable. df has a unique row_id, feature columns, embedding columns (arrays) named in reps, and annotations."""

    df: DataFrame
    features: list[str]
    reps: list[str] = field(default_factory=list)
    row_id: str = "row_id"
    meta: dict = field(default_factory=dict)

    @property
    def annotations(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.features and c not in self.reps]

    def pipe(self, f: Callable[..., DataFrame], *args, **kw) -> Profile:
        """f(df, ...) with the same features."""
        return replace(self, df=f(self.df, *args, **kw))

    def select(self, features: list[str]) -> Profile:
        gone = [f for f in self.features if f not in features]
        return replace(self, df=self.df.drop(*gone), features=[f for f in self.features if f in features])

    def note(self, **meta: object) -> Profile:
        return replace(self, meta=self.meta | meta)
