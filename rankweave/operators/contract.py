"""What every encoding of a symbol sequence answers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class SymbolSequence(Protocol):
    """A sequence of symbols at positions from 0; queries are tables keyed by ``qid``, ranges half-open."""

    def get(self, queries: DataFrame) -> DataFrame:
        """Symbol at ``at`` (column ``sym``); null outside the sequence."""

    def count(self, queries: DataFrame) -> DataFrame:
        """Occurrences (``cnt``) of ``symbol`` in ``[lo, hi)``; 0 for symbols that do not occur."""

    def select(self, queries: DataFrame, *, last: bool = False) -> DataFrame:
        """Position (``pos``) of the k-th occurrence of ``symbol`` from the left or right; null if there are fewer."""

    def simple_majority(self, queries: DataFrame) -> DataFrame:
        """The symbol of more than half of ``[lo, hi)``, or null."""

    def stats(self) -> DataFrame:
        """Length, largest symbol and number of levels."""
