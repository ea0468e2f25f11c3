"""The queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations


def registered() -> dict[str, tuple]:
    from . import curation, evaluation, linking  # noqa: F401
    from .tables import REGISTRY

    return dict(REGISTRY)
