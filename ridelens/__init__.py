"""ridelens: bike-share trip analytics on Spark DataFrames.

Layers:
  sources/    trip records in (test-table adapter, CSV files) and result files out
  functions/  scalar trip operators as Column expressions and SQL functions
  operators/  cohort cleaning and the demand / rider / fleet / distance / model questions
  plans/      the named query catalogue, its SQL oracle and plan inspection helpers
  streaming/  incremental ingest of newly arriving trip files
"""

__version__ = "0.1.0"
