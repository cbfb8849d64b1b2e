"""Profiling, preparation and regression of wide business tables on Spark."""
