"""Settings of the validated ETL flow and what the environments change."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from shelfline.operators.quality import Limits


@dataclass(frozen=True)
class EtlSettings:
    """`base` is a folder on shared storage; data and reports of an
    environment are written below `<base>/<environment>`."""
    base: str
    environment: str = "production"
    stop_on_failure: bool = True
    check_drift: bool = True
    retries: int = 3
    limits: Limits = field(default_factory=Limits)

    @property
    def data_path(self) -> str:
        return os.path.join(self.base, self.environment, "sales")

    @property
    def report_path(self) -> str:
        return os.path.join(self.base, self.environment, "report")


# Whether a failed validation stops the run, and retries.
STOP_AND_RETRIES = {"development": (False, 1), "staging": (True, 2), "production": (True, 3)}


def settings_for(environment: str, base: str, **changes) -> EtlSettings:
    """Settings of a named environment; `changes` come last."""
    if environment not in STOP_AND_RETRIES:
        raise ValueError(f"no such environment: {environment}")
    stop, retries = STOP_AND_RETRIES[environment]
    return replace(EtlSettings(base, environment, stop, retries=retries), **changes)
