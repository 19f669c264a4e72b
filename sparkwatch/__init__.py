"""Detection-rule analytics on Spark: rules become Columns, logs stay DataFrames."""
