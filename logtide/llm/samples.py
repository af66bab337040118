"""Bounded samples of rows to fit a model on. Which rows are drawn depends on the rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drawn(share: Column | float, *of: str, seed: int = 5) -> Column:
    """True for about ``share`` of the rows, by a hash of the named columns."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in of]), 11)
    return bits / float(2 ** 53) < share


def share_of(n: int, rows: int) -> float:
    """Share that gives about ``n`` of ``rows`` rows."""
    return min(1.0, n / rows) if rows else 1.0


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))


def sample_rows(docs: DataFrame, n: int, *of: str) -> DataFrame:
    """About ``n`` rows of ``docs``."""
    return docs.filter(drawn(share_of(n, docs.count()), *of))
