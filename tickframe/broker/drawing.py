"""Drawing objects as geometry: lines, boxes, labels and fills between lines, held by a strategy in its memory."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

CAP = 50


@dataclass
class Line:
    x1: int
    y1: float
    x2: int
    y2: float
    by_time: bool = False
    left: bool = False
    right: bool = False


@dataclass
class Box:
    left: int
    top: float
    right: int
    bottom: float
    by_time: bool = False


@dataclass
class Label:
    x: int
    y: float
    text: str = ""
    by_time: bool = False
    place: str = "price"


@dataclass
class Fill:
    line1: int
    line2: int


class DrawingError(RuntimeError):
    """Use of an object that never was."""


@dataclass
class Arena:
    """Objects of one kind by number. Beyond ``cap`` living ones the oldest go; numbers are not used again.

    What has gone can still be read and set, but not copied; None is no object.
    """

    cap: int = CAP
    records: list[Any] = field(default_factory=list)
    living: deque = field(default_factory=deque)

    def new(self, record: Any) -> int:
        while len(self.living) >= max(1, self.cap):
            self.living.popleft()
        self.records.append(record)
        self.living.append(len(self.records) - 1)
        return len(self.records) - 1

    def __getitem__(self, number: int | None) -> Any:
        if number is None or not 0 <= number < len(self.records):
            raise DrawingError("no such drawing object")
        return self.records[number]

    def set(self, number: int | None, **values: Any) -> None:
        record = self[number]
        for name, value in values.items():
            if not hasattr(record, name):
                raise DrawingError(f"no property {name}")
            setattr(record, name, value)

    def copy(self, number: int | None) -> int | None:
        return self.new(replace(self.records[number])) if number in self.living else None

    def delete(self, number: int | None) -> None:
        if number in self.living:
            self.living.remove(number)


@dataclass
class Drawings:
    """All arenas of a run."""

    lines: Arena = field(default_factory=Arena)
    boxes: Arena = field(default_factory=Arena)
    labels: Arena = field(default_factory=Arena)
    fills: Arena = field(default_factory=Arena)

    def line_price(self, number: int | None, x: int) -> float | None:
        """The price of the endless line at a bar; None if it is vertical, an error if it is drawn by time."""
        line = self.lines[number]
        if line.by_time:
            raise DrawingError("a line by time has no price at a bar")
        return None if line.x1 == line.x2 else line.y1 + (line.y2 - line.y1) / (line.x2 - line.x1) * (x - line.x1)


def line_price(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """As above, over columns."""
    return y1 + F.try_divide(y2 - y1, (x2 - x1).cast("double")) * (x - x1)
