"""Scans, record contracts and sinks (SRC-*, SNK-*)."""
