"""Operators on rasters, polylines, series and populations."""
