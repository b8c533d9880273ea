"""ledgerloom: spreadsheet-style formulas, bindings and allocation compiled to Spark plans."""

__version__ = "0.1.0"
