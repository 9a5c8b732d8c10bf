"""tagloom: track tagging, tag combination and mistag calibration as Spark DataFrame operators."""
