"""Line parsers: a text column in, a typed event column out."""

from tripline.operators.parsing.dispatch import (
    ParseOptions,
    accepted,
    parse_lines,
    parse_mixed,
    register_format,
    sort_out,
    supported_formats,
    to_events,
)
from tripline.operators.parsing.sniff import sniff_files, sniff_groups, sniff_paths

__all__ = [
    "ParseOptions",
    "accepted",
    "parse_lines",
    "parse_mixed",
    "register_format",
    "sniff_files",
    "sniff_groups",
    "sniff_paths",
    "sort_out",
    "supported_formats",
    "to_events",
]
