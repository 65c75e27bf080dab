"""Reconciliation, matching and ledger analytics as PySpark DataFrame operators."""
