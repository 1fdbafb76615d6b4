"""Behavioural-history analytics on Spark: functions from DataFrame to DataFrame."""
