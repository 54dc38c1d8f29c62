"""Schemas of tables that are read from outside, as Spark DDL."""

from __future__ import annotations

RECORDINGS = "path string, sr int, channels int, samples array<short>"
