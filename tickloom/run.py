"""What a run of the engine is made of. Every query takes a folder of order tables, or a Run where something else than the usual is wanted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from tickloom.config import BUFFER_BARS, HORIZONS, STEP, WARMUP

#: Universes derived from the order tables; any other name is the path of a universe file.
UNIVERSES = ("suppliers", "customers")


@dataclass(frozen=True)
class Run:
    """A frozen run: tables that queries share are kept by it, so runs that differ in anything share nothing.

    folder: the order tables. universe: one of UNIVERSES, or a universe file (a line for each ticker). Evaluation dates
    are every `step` bars of the calendar from bar `warmup` on, `buffer` bars before its end at the latest; signals are
    measured `horizons` bars on. until: a date (YYYY-MM-DD) after which nothing is known to the run.
    """

    folder: str
    universe: str = UNIVERSES[0]
    step: int = STEP
    warmup: int = WARMUP
    buffer: int = BUFFER_BARS
    horizons: tuple[int, ...] = HORIZONS
    until: str | None = None

    def __post_init__(self) -> None:
        for name, low, high in (("step", 1, 10), ("warmup", 0, None), ("buffer", 0, None)):
            x = getattr(self, name)
            if not isinstance(x, int) or isinstance(x, bool) or x < low or (high is not None and x > high):
                raise ValueError(f"{name} must be a whole number from {low}" + (f" to {high}" if high is not None else " on") + f", not {x!r}")
        if not self.horizons or any(not isinstance(h, int) or h < 1 for h in self.horizons) or list(self.horizons) != sorted(set(self.horizons)):
            raise ValueError(f"horizons must be ascending whole numbers from 1 on, not {self.horizons!r}")
        if self.until is not None:
            date.fromisoformat(self.until)
        if not self.universe:
            raise ValueError("universe must be named")


def run_of(d: str | Run) -> Run:
    return d if isinstance(d, Run) else Run(d)


def from_arguments(arguments: Sequence[str]) -> tuple[Run, list[str], str | None]:
    """The run, the names of queries and the folder for results of command-line arguments (--name=value, and names).

    A run with another step than the usual needs a folder of its own, so that it can't replace the published results.
    """
    flags, names = {}, []
    for a in arguments:
        if a.startswith("--"):
            name, _, value = a[2:].partition("=")
            if name not in ("data", "universe", "step", "warmup", "buffer", "horizons", "until", "out") or not value:
                raise ValueError(f"not understood: {a}")
            flags[name] = value
        else:
            names.append(a)
    if "data" not in flags:
        raise ValueError("--data=FOLDER is missing")
    whole = {k: int(flags[k]) if flags[k].lstrip("-").isdigit() else flags[k] for k in ("step", "warmup", "buffer") if k in flags}
    if "horizons" in flags:
        whole["horizons"] = tuple(int(x) if x.isdigit() else x for x in flags["horizons"].split(","))
    run = Run(flags["data"], flags.get("universe", UNIVERSES[0]), until=flags.get("until"), **whole)
    if run.step != STEP and "out" not in flags:
        raise ValueError(f"--out=FOLDER is needed where --step isn't {STEP}")
    return run, names, flags.get("out")
