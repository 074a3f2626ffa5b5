"""Analytics operators: DataFrame -> DataFrame functions."""
