"""Stylometry over text tables, Spark first."""
