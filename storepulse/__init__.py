"""storepulse — dark-store operations analytics as lazy Spark DataFrame plans.

Sub-packages:
  functions  column-expression helpers (rounding contract, rates, bands, hashing)
  sources    schemas, star-schema fixtures derived from the driver tables, IO
  operators  cleaning rules, profiling, column rewrites, sampling, generic ops
  plans      the named analytics (SLA, P&L, pickers, products, demand, reports)
"""

__all__ = ["functions", "sources", "operators", "plans"]
