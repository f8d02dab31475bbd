"""The expression language: names, types, aggregates and the scanner of rule texts."""
