from ledgerloom.sources import types  # noqa: F401  (registers the source types)
