"""Relational building blocks: each takes DataFrames and returns DataFrames, without running a job."""
