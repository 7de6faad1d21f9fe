"""Operators on rasters, masks, cell tables and annotations."""
