"""Audits the quality of reward-style evaluation environments with Spark DataFrames."""
