"""Log lines to the console and to a file named by the time of its start."""

from __future__ import annotations

import logging
import os
from datetime import datetime

FORMAT = "[%(asctime)s] [%(levelname)s] %(message)s"


def stamp(at: datetime) -> str:
    return at.strftime("%Y-%m-%d_%H-%M-%S")


def start_log(name: str, folder: str, level: int = logging.INFO, at: datetime | None = None) -> tuple[logging.Logger, str]:
    """A logger of the driver with both sinks, and its file's path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}_{stamp(at or datetime.now())}.log")
    logger = logging.getLogger(name)
    logger.setLevel(level)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for sink in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        sink.setFormatter(logging.Formatter(FORMAT))
        logger.addHandler(sink)
    logger.propagate = False
    return logger, path
