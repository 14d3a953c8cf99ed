"""Spreadsheet-grade calculation, reconciliation and corpus preparation on Spark DataFrames."""
