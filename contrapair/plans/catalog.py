"""Everything that is registered."""

from __future__ import annotations

from contrapair.plans import contrasts, ingest, models, nearcopy, report, resample, scoring, signatures, splits  # noqa: F401
from contrapair.plans.registry import CHECKS, QUERIES


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)
