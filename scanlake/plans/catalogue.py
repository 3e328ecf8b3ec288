"""Imports every module that registers queries."""

from scanlake.plans import catalog, evaluate, identity, imagestats, kernels, layout, lookups, report, similarity, sizing  # noqa: F401
