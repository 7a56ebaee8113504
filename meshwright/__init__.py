"""Graph analytics on Spark: edge ingest, layouts and iterative vertex programs as DataFrame plans."""
