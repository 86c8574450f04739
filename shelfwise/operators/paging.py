"""Pages and strips: offsets and limits, worked out on the driver from a count."""

from __future__ import annotations

from dataclasses import dataclass

from shelfwise.constraints import Constraint, QueryError
from shelfwise.functions import expressions


@dataclass(frozen=True)
class Slice:
    offset: int
    limit: int


def _gaps(spacing: Constraint | None, page: int) -> int:
    """Places of a page that are kept free: those of all gaps that hold for it."""
    if spacing is None:
        return 0
    return sum(int(g.values[0]) for g in spacing.all("gap") if expressions.evaluate(str(g.values[1]), {"pageNumber": page}))


def window(c: Constraint | None, total: int) -> Slice:
    """The slice of a page or strip; without either, the first page of 20. Beyond the end, the first one."""
    if c is None:
        return Slice(0, 20)
    if c.name == "strip":
        offset, limit = [*c.values[:2], *(0, 20)[len(c.values) :]]
        if offset < 0 or limit < 0:
            raise QueryError("a strip has no negative offset or limit")
        return Slice(offset if offset < total else 0, limit)
    number, size = [*c.values[:2], *(1, 20)[len(c.values) :]]
    if number < 1 or size < 0:
        raise QueryError("pages are numbered from 1 and have no negative size")
    spacing = c.child("spacing")
    if spacing is None:
        return Slice((number - 1) * size if (number - 1) * size < total else 0, size)
    offset = sum(max(0, size - _gaps(spacing, p)) for p in range(1, number))
    if offset >= total:
        number, offset = 1, 0
    return Slice(offset, max(0, size - _gaps(spacing, number)))
