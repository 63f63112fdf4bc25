"""All queries of the engine and their SQL; each module adds its own."""

from quire.plans import layout, lexical, scoring, store, texts  # noqa: F401
from quire.plans.queries import ORACLES, QUERIES  # noqa: F401
