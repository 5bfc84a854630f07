"""Spark-native molecular analytics: datasets of molecules as DataFrames."""
