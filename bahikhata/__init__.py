"""PySpark statement and ledger analytics."""
