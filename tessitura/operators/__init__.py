"""Generic operators: functions of DataFrames and column names that return DataFrames.

They declare a plan and run nothing. Every operator that depends on order takes a total order; ties beyond it are not defined.
"""
