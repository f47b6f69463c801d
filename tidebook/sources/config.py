"""Where data lies and what a collection is called."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

ROOT_VARIABLE = "TIDEBOOK_DATA_ROOT"
LAYERS = ("raw", "processed", "derived", "reports")


def data_root(explicit: str | None = None) -> Path:
    """Given place, else the environment's, else ./data."""
    return Path(explicit or os.environ.get(ROOT_VARIABLE) or "data").expanduser().resolve()


def prepare(root: Path) -> list[Path]:
    made = [root / layer for layer in LAYERS]
    for p in made:
        p.mkdir(parents=True, exist_ok=True)
    return made


def address(text: str) -> str:
    """A contract address in lower case; anything else is an error."""
    low = text.strip().lower()
    if not re.fullmatch(r"0x[0-9a-f]{40}", low):
        raise ValueError(f"not an address: {text!r}")
    return low


@dataclass(frozen=True)
class Collection:
    """A half-open range of blocks of one pool of two tokens."""

    pool: str
    token0_decimals: int
    token1_decimals: int
    start_block: int
    end_block: int

    def __post_init__(self):
        object.__setattr__(self, "pool", address(self.pool))
        if not 0 <= self.start_block < self.end_block:
            raise ValueError("blocks are not a range")
        if not (0 <= self.token0_decimals <= 36 and 0 <= self.token1_decimals <= 36):
            raise ValueError("decimals out of range")

    @property
    def run_id(self) -> str:
        return f"{self.pool[2:10]}_b{self.start_block}_b{self.end_block}"
