"""Rolling sums, means and deviations with constant work per row.

A sliding frame is summed up again for every row, so a 50-row frame costs 50 updates a row. Here a
level first makes blocks of seven rows, and the next level puts a window of n rows together from n // 7
blocks and n % 7 single rows, all of them ``lag`` values of the same partitioning and order.

Each such value is a column of its own, made once in the level that reads it (``backs``, ``total_backs``, ``std_backs``)
and dropped after it: Spark computes a ``lag`` again wherever an expression repeats it.

A window that is not full or holds a null gives null by itself, because a missing ``lag`` value is null.
Deviations are taken from the newest value and merged block by block, so a flat window has exactly 0.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.frames import BACK, by_ticker

BLOCK = 7


def _sum(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _back(name: str, rows: int) -> Column:
    return F.col(f"{BACK}{rows}_{name}") if rows else F.col(name)


def _backs(name: str, rows: Iterable[int]) -> dict[str, Column]:
    return {f"{BACK}{k}_{name}": F.lag(name, k).over(by_ticker()) for k in rows if k}


@dataclass(frozen=True)
class Rolling:
    """Windows over one existing double column."""

    column: str

    @property
    def _total(self) -> str:
        return f"_block_total_{self.column}"

    @property
    def _mean(self) -> str:
        return f"_block_mean_{self.column}"

    @property
    def _spread(self) -> str:
        return f"_block_spread_{self.column}"

    def back(self, rows: int) -> Column:
        """The value some rows before, in a level that has it among its :meth:`backs`."""
        return _back(self.column, rows)

    def backs(self, *rows: int) -> dict[str, Column]:
        return _backs(self.column, rows)

    def total_backs(self, n: int) -> dict[str, Column]:
        """What :meth:`total` and :meth:`mean` read, for the same level."""
        blocks, singles = self._offsets(n)
        return _backs(self._total, blocks) | _backs(self.column, singles)

    def std_backs(self, n: int) -> dict[str, Column]:
        """What :meth:`std` reads, for the same level."""
        blocks, singles = self._offsets(n)
        return _backs(self._mean, blocks) | _backs(self._spread, blocks) | _backs(self.column, singles)

    def total_blocks(self) -> dict[str, Column]:
        """Level before :meth:`total` and :meth:`mean`."""
        return self.backs(*range(1, BLOCK)) | {self._total: _sum([_back(self.column, i) for i in range(BLOCK)])}

    def spread_blocks(self) -> dict[str, Column]:
        """Level before :meth:`std`: mean and sum of squared deviations of a block."""
        newest = F.col(self.column)
        gaps = [_back(self.column, i) - newest for i in range(1, BLOCK)]
        shift = _sum(gaps)
        spread = _sum([g * g for g in gaps]) - shift * shift / BLOCK
        return self.backs(*range(1, BLOCK)) | {self._mean: newest + shift / BLOCK, self._spread: spread}

    def _offsets(self, n: int) -> tuple[list[int], list[int]]:
        whole = n // BLOCK
        return [j * BLOCK for j in range(whole)], list(range(whole * BLOCK, n))

    def total(self, n: int) -> Column:
        blocks, singles = self._offsets(n)
        return _sum([_back(self._total, o) for o in blocks] + [_back(self.column, o) for o in singles])

    def mean(self, n: int) -> Column:
        return self.total(n) / n

    def std(self, n: int) -> Column:
        """Sample deviation; a window without a whole block is put together from single rows."""
        blocks, singles = self._offsets(n)
        if not blocks:
            gaps = [_back(self.column, i) - F.col(self.column) for i in singles[1:]]
            shift = _sum(gaps)
            inner = _sum([g * g for g in gaps]) - shift * shift / n
            return F.sqrt(F.when(inner < 0, 0.0).otherwise(inner) / (n - 1))
        newest = F.col(self._mean)
        parts = [(BLOCK, _back(self._mean, o) - newest) for o in blocks[1:]]
        parts += [(1, _back(self.column, o) - newest) for o in singles]
        inner = _sum([_back(self._spread, o) for o in blocks])
        if parts:
            shift = _sum([gap * size for size, gap in parts])
            inner = inner + _sum([gap * gap * size for size, gap in parts]) - shift * shift / n
        # Rounding may leave a tiny negative sum; a null must stay null.
        return F.sqrt(F.when(inner < 0, 0.0).otherwise(inner) / (n - 1))

    def helpers(self) -> list[str]:
        return [self._total, self._mean, self._spread]
