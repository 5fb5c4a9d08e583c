"""Logging to the console and, if asked, to a file."""

from __future__ import annotations

import logging
from pathlib import Path


def logger(name: str = "palimpsest", level: int = logging.INFO, file: str | None = None) -> logging.Logger:
    """A logger with one handler for each place, however often it is asked for."""
    log = logging.getLogger(name)
    log.setLevel(level)
    wanted = {"console": logging.StreamHandler}
    if file:
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        wanted[str(Path(file).resolve())] = lambda: logging.FileHandler(file, encoding="utf-8")
    for place in wanted.keys() - {h.name for h in log.handlers}:
        handler = wanted[place]()
        handler.name = place
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
