"""One exception type with a machine-readable code.

Codes that depend on parameters are raised while a plan is built; codes that
depend on the data are raised by the single pre-check action an operator runs.
"""

from __future__ import annotations

from typing import Any

# The analytical error codes callers may match on.
ANALYSIS_INPUT_INVALID = "ANALYSIS_INPUT_INVALID"
ANALYSIS_INSUFFICIENT_SAMPLES = "ANALYSIS_INSUFFICIENT_SAMPLES"
ANALYSIS_STALE = "ANALYSIS_STALE"
RESULT_INCOMPATIBLE = "RESULT_INCOMPATIBLE"
DATASET_CHANGED = "DATASET_CHANGED"
UNSUPPORTED_PERIODICITY = "UNSUPPORTED_PERIODICITY"
INVALID_DATASET = "INVALID_DATASET"
ARTIFACT_INVALID = "ARTIFACT_INVALID"
JOB_CANCELLED = "JOB_CANCELLED"


class LoomError(ValueError):
    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(f"{code}: {message}" + (f" {details}" if details else ""))
        self.code = code
        self.details = details


def invalid(message: str, **details: Any) -> LoomError:
    return LoomError(ANALYSIS_INPUT_INVALID, message, **details)


def insufficient(needed: int, got: int) -> LoomError:
    return LoomError(
        ANALYSIS_INSUFFICIENT_SAMPLES, f"at least {needed} samples are required", samples=got, minimum=needed
    )
