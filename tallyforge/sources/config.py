"""Settings of a ledger, from TOML or code."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class LedgerConfig:
    root: str = "ledger"
    transactions_per_segment: int = 1000
    snapshot_frequency: int = 2
    dedup: bool = True

    def __post_init__(self) -> None:
        if self.transactions_per_segment < 1:
            raise ValueError("transactions_per_segment must be 1 or more")
        if self.snapshot_frequency < 1:
            raise ValueError("snapshot_frequency must be 1 or more")
        if not self.root:
            raise ValueError("root is empty")

    @property
    def dedup_window(self) -> int:
        """References are kept for one to two segments."""
        return self.transactions_per_segment


def load(path: str) -> LedgerConfig:
    with open(path, "rb") as f:
        found = tomllib.load(f).get("ledger", {})
    known = {f.name for f in fields(LedgerConfig)}
    if unknown := set(found) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return LedgerConfig(**found)
