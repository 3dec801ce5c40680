"""swatch: sample-to-bulk order and customer analytics as Spark DataFrame operators.

Sub-packages:
  sources/    table and order-file reads, snapshot writes and publishing
  functions/  scalar column expressions
  operators/  ingest cleaning, merges, customer derivation, conversion analysis, reports, checks
  plans/      column mappings onto the driver tables and the registered queries
  streaming/  micro-batch adapters for the merge operators
"""

__version__ = "0.1.0"
