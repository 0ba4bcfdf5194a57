"""cohortlake: cohort, annotation and evaluation operators on PySpark DataFrames."""
