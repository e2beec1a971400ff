"""Positions that spans take up."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class Taken:
    """The edges of disjoint spans in order. A place at an even number of edges lies between spans, at an odd one inside of one."""

    def __init__(self) -> None:
        self.edges: list[int] = []

    def take(self, start: int, end: int) -> bool:
        """Take [start, end) up if all of it is free."""
        at = bisect_right(self.edges, start)
        if at % 2 or at != bisect_left(self.edges, end):
            return False
        self.edges[at:at] = (start, end)
        return True
