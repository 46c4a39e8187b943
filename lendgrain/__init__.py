"""Portfolio-scale corporate credit appraisal on PySpark DataFrames."""
