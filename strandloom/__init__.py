"""Strandloom: simulating and analysing RNA sequencing data with Spark DataFrames."""
