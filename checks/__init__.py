"""Test bindings: catalog views derived from the test tables, queries, oracles."""
