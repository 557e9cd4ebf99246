"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from wavespan.catalog.registry import ORACLES, QUERIES, query  # noqa: F401
from wavespan.catalog import (  # noqa: F401,E402
    assembly, changes, codes, descriptive, events, exposure, landing, long_chain, models, recodes, samples,
    semantics, spells)
