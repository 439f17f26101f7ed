"""All registered queries and their SQL."""

from __future__ import annotations

from muxlake.plans import audio, content, damaged, more, relational, rulesets, summaries, signalling, telemetry, texts, timeline, views

MODULES = [audio, content, damaged, more, relational, rulesets, summaries, signalling, telemetry, texts, timeline]
QUERIES: dict = views.QUERIES
ORACLE: dict = views.ORACLE
