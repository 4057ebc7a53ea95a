"""Structured Streaming forms of the operators."""

from wardline.streaming.joins import stream_enrich, stream_match_rules, stream_unmatched_iocs
from wardline.streaming.sinks import current_table, drain, split_late, stream_buffered, stream_upsert
from wardline.streaming.state import stream_correlate, stream_dedup, stream_frequency, stream_throttle
from wardline.streaming.windows import stream_sessions, stream_sliding, stream_top_talkers, stream_tumbling

__all__ = [
    "current_table", "drain", "split_late", "stream_buffered", "stream_correlate", "stream_dedup", "stream_enrich", "stream_frequency",
    "stream_match_rules", "stream_sessions", "stream_sliding", "stream_throttle", "stream_top_talkers", "stream_tumbling", "stream_unmatched_iocs",
    "stream_upsert",
]
