"""Imports every family, which fills the registry."""

from suite import analysis, charts, lineage, logs, recipes, relational, scalars, sources, streams  # noqa: F401
