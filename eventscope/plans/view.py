"""What a user is looking at: parameters of the queries, never a table."""

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class View:
    start: dt.datetime | str
    end: dt.datetime | str
    filters: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    shapes: tuple[str, ...] = ()
    colour_sets: tuple[tuple[str, ...], ...] = ()
    keep_nonlocated: bool = False
    selected: tuple[str, ...] = ()

    @classmethod
    def saved(cls, range, **rest) -> "View":
        """From a saved view, whose two times may come in either order."""
        start, end = sorted(range)
        return cls(start, end, **rest)
