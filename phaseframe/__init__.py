"""Haplotype-phasing analytics on Spark DataFrames."""
