"""Motifmill: preparing and measuring symbolic-music collections with Spark DataFrames."""
