"""Review analytics on Spark: landing, matching, merging, checking and scoring of location reviews."""
