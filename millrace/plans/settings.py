"""The engine's parameters, each of which the session may override."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.chunking import Sizes


@dataclass(frozen=True)
class Settings:
    """Sizes and limits; ``spark.millrace.<name>`` of the session takes the place of a default."""

    child_tokens: int = 150
    parent_tokens: int = 700
    parent_paragraphs: int = 4
    child_paragraphs: int = 1
    parent_sentences: int = 8
    child_sentences: int = 3
    parent_words: int = 400
    child_words: int = 120
    embed_batch: int = 64
    variations: int = 3
    prefetch: int = 20
    kept: int = 5
    legal_collection: str = "legal"
    drug_collection: str = "drug"

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """The defaults with what the session sets."""
        given = {f.name: spark.conf.get(f"spark.millrace.{f.name}", None) for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name] is not None})

    def sizes(self) -> Sizes:
        """Units per parent, and per child with their overlap."""
        return Sizes((self.parent_paragraphs, self.child_paragraphs, 0), (self.parent_sentences, self.child_sentences, 1), (self.parent_words, self.child_words, 30), self.parent_tokens, (self.child_tokens, 30))

    def table(self, spark: SparkSession) -> DataFrame:
        """``name, value`` of each."""
        return spark.createDataFrame([(f.name, str(getattr(self, f.name))) for f in fields(self)], "name string, value string")
