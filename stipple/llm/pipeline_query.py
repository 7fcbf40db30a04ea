"""The corpus pipeline as a named query."""

from __future__ import annotations

import corpus_pipeline
from stipple.llm.registry import named

named("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
