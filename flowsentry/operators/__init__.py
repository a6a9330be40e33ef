"""Detection, grouping, decision and training operators (DataFrame in, DataFrame out)."""
