"""The places where a caller's own parts fit in, and the parts that fill them by default."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession

from kinfold.functions import gauss
from kinfold.operators.signature import sign
from kinfold.sources import delimited

from .definitions import SchemaDef, SourceDef


@runtime_checkable
class Source(Protocol):
    """Gives records: a column id and named string attributes."""

    def records(self, spark: SparkSession) -> DataFrame: ...


@runtime_checkable
class Signer(Protocol):
    """Gives (id, signature, sign_error) for records; an index takes signatures from any."""

    @property
    def signature_length(self) -> int: ...

    @property
    def chunk_bits(self) -> int: ...

    def sign(self, records: DataFrame) -> DataFrame: ...


@runtime_checkable
class Classifier(Protocol):
    """What signing needs to know of the terms. Any counts do, learnt or brought along.

    counts: (field_idx, term, cnt); fields: (field_idx, total, dim, field_offset), one row a
    field; table: (field_idx, term, cnt, term_idx, total, dim, weight), one row a term."""

    @property
    def schema(self) -> SchemaDef: ...

    @property
    def counts(self) -> DataFrame: ...

    @property
    def fields(self) -> DataFrame: ...

    @property
    def table(self) -> DataFrame: ...


@runtime_checkable
class RandomProvider(Protocol):
    """A number for an index, always the same one."""

    def get(self, index: Column) -> Column: ...


@dataclass(frozen=True)
class DelimitedSource:
    """Delimited files as a source."""

    definition: SourceDef

    def records(self, spark: SparkSession) -> DataFrame:
        return delimited.read(spark, self.definition)


@dataclass(frozen=True)
class LearntSigner:
    """Signatures from a learnt vocabulary, or from another classifier."""

    vocabulary: Classifier
    seed: str | RandomProvider = gauss.SEED
    oov: str = "reference"

    @property
    def signature_length(self) -> int:
        return self.vocabulary.schema.chunks

    @property
    def chunk_bits(self) -> int:
        return self.vocabulary.schema.width

    def sign(self, records: DataFrame) -> DataFrame:
        return sign(records, self.vocabulary, self.seed, self.oov)


@dataclass(frozen=True)
class Gauss:
    """Quantised normal components by index."""

    seed: str = gauss.SEED

    def get(self, index: Column) -> Column:
        return gauss.component(index, self.seed)
