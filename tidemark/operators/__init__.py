"""Query operators: functions from DataFrames to DataFrames."""
