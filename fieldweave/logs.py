"""Logs as JSON lines, on the error stream and in a file; nothing is created on import."""

from __future__ import annotations

import datetime as dt
import json
import logging
from pathlib import Path


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        when = dt.datetime.fromtimestamp(record.created, dt.UTC).isoformat()
        row = {"time": when, "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if stage := getattr(record, "stage", None):
            row["stage"] = stage
        if record.exc_info:
            row["error"] = self.formatException(record.exc_info)
        return json.dumps(row)


def configured(name: str = "fieldweave", file: str | None = None, level: str = "INFO") -> logging.Logger:
    """The logger of that name, set up once."""
    logger = logging.getLogger(name)
    if not logger.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if file:
            Path(file).parent.mkdir(parents=True, exist_ok=True)
            handlers.append(logging.FileHandler(file, encoding="utf-8"))
        for handler in handlers:
            handler.setFormatter(JsonLines())
            logger.addHandler(handler)
        logger.setLevel(getattr(logging, level.upper(), logging.INFO))
        logger.propagate = False
    return logger
