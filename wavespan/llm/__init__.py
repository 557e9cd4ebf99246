"""Operators for preparing language-model training data, and their queries."""

from wavespan.llm.registry import ORACLES, QUERIES  # noqa: F401
from wavespan.llm import queries  # noqa: F401,E402
