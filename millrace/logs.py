"""Logging of the package."""

from __future__ import annotations

import logging

ROOT = "millrace"


def get_logger(name: str = "") -> logging.Logger:
    return logging.getLogger(f"{ROOT}.{name}" if name else ROOT)


def level_of(level: int | str) -> int:
    """A level by number or name."""
    found = level if isinstance(level, int) else logging.getLevelNamesMapping().get(level.upper())
    if found is None:
        raise ValueError(f"unknown log level {level!r}")
    return found


def configure(level: int | str = "INFO", pretty: bool = True) -> logging.Logger:
    """One handler on the package's logger, with times if pretty."""
    log = get_logger()
    log.handlers[:] = [logging.StreamHandler()]
    log.handlers[0].setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s" if pretty else "%(levelname)s:%(name)s:%(message)s"))
    log.setLevel(level_of(level))
    log.propagate = False
    return log
