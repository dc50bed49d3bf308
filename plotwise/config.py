"""Parameters of an analysis; passed to operators, never global."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    cell_ft: float = 10.0
    vacant_as_neutral: bool = True
    burn_forward: bool = True
    null_shifts: int = 400
    null_min_ft: float = 3000.0
    null_max_ft: float = 20000.0
    decay_max_ft: float = 3000.0
    decay_step_ft: float = 250.0
    decay_directions: int = 8
    block_ft: float = 2000.0
    bootstrap_reps: int = 600
    seed: int = 0

    @property
    def cell_acres(self) -> float:
        return self.cell_ft**2 / 43560.0
