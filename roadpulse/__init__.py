"""roadpulse: Spark-native incident analytics and forecasting.

Layout:
  sources/    scans and sinks (incident tables, prediction log, lookup store)
  functions/  column expressions (geohash, time features, rules, keywords)
  operators/  DataFrame -> DataFrame operators (cleaning, lookups, drift, ...)
  plans/      jobs composed from operators (training, scoring, retraining)
  streaming/  Structured Streaming jobs (lookup upkeep, scoring, monitoring)
"""

__version__ = "0.1.0"
