"""Parameters of a run, by name: text is read as the type that is asked for, and the default holds where it can't be."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SOURCES = ("open", "high", "low", "close", "volume", "hl2", "hlc3", "ohlc4", "hlcc4")
_NUMBER = r"\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|nan)"


@dataclass(frozen=True)
class Inputs:
    """Values as they were given, and numbers about the symbol."""

    values: dict[str, object] = field(default_factory=dict)
    symbol: dict[str, float] = field(default_factory=dict)

    def _text(self, key: str) -> str | None:
        return str(self.values[key]) if key in self.values else None

    def number(self, key: str, default: float) -> float:
        """The number that the text begins with."""
        found = re.match(_NUMBER, self._text(key) or "")
        return float(found[0]) if found else default

    def integer(self, key: str, default: int, bits: int = 32) -> int:
        """The whole number that the text begins with; one beyond ``bits`` bits is none."""
        found = re.match(r"\s*[+-]?\d+", self._text(key) or "")
        value = int(found[0]) if found else default
        return value if -(1 << bits - 1) <= value < 1 << bits - 1 else default

    def flag(self, key: str, default: bool) -> bool:
        value = self.values.get(key)
        return {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower() if isinstance(value, bool) else str(value), default)

    def text(self, key: str, default: str) -> str:
        found = self._text(key)
        return default if found is None else found

    def choice(self, key: str, default: str, options: tuple[str, ...]) -> str:
        found = self.text(key, default)
        return found if found in options else default

    def source(self, key: str, default: str = "close") -> str:
        """One of a bar's own series, by name."""
        return self.choice(key, default, SOURCES)

    def meta(self, key: str) -> float | None:
        """A number about the symbol, None if it wasn't given."""
        return self.symbol.get(key)


@dataclass(frozen=True)
class Symbol:
    """What is known of an instrument."""

    ticker: str = ""
    currency: str = "USD"
    base_currency: str = ""
    kind: str = ""
    zone: str = "UTC"
    session: str = "24x7"
    volume_kind: str = ""
    description: str = ""
    tick: float = 0.01
    point_value: float = 1.0
    lot: float = 0.0
    prefix: str = ""

    @property
    def ticker_id(self) -> str:
        return f"{self.prefix}:{self.ticker}" if self.prefix else self.ticker

    def standard(self, ticker_id: str | None = None) -> str:
        """A plain ticker as it is; there are no modified ones."""
        return ticker_id or self.ticker_id
