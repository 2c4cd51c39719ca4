"""Columns by their literal names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """``name`` as one SQL identifier, whatever characters it holds (dots and back-ticks included)."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """The column called exactly ``name``. ``F.col`` reads a dot as a step into a struct."""
    return F.col(quoted(name))


def cols(names: Iterable[str] | DataFrame) -> list[Column]:
    """:func:`col` of every name, or of every column of a frame."""
    return [col(n) for n in (names.columns if isinstance(names, DataFrame) else names)]
