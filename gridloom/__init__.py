"""Gridloom: analytics over gridded, labelled and polyline data on Spark DataFrames."""
