"""``python -m fieldweave.sources SETTINGS``: discover datasets, write the report and print it."""

from __future__ import annotations

import json
import sys

from ..logs import configured
from ..session import build
from .catalog import discover
from .config import load


def main(path: str) -> None:
    settings = load(path)
    log = configured("fieldweave.discovery", settings.log_file, settings.log_level)
    log.info("discovery for %s", settings.request.aoi_name, extra={"stage": "discovery"})
    found, report = discover(build("discovery"), settings)
    for warning in report["warnings"]:
        log.warning(warning, extra={"stage": "discovery"})
    log.info("%s candidates", found.count(), extra={"stage": "discovery"})
    print(json.dumps(report, indent=2))


if __name__ == "__main__":
    main(sys.argv[1])
