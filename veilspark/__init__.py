"""veilspark: detection and redaction of sensitive values at table scale, on Spark DataFrames."""
