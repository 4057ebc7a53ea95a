"""Reading and writing: tables by pattern, indicator lists, lines, routed and published output."""

from wardline.sources.scan import read_indicator_csv, replay_tail, scan_glob, split_indicators
from wardline.sources.sink import ingest_lines, publish_cti_events, route, write_routed

__all__ = [
    "ingest_lines", "publish_cti_events", "read_indicator_csv", "replay_tail", "route", "scan_glob",
    "split_indicators", "write_routed",
]
