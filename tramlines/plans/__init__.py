"""The registered queries: both modules add theirs to the catalog."""

from . import catalog, network, shapes, ways  # noqa: F401
