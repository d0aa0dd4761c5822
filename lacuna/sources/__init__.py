"""Readers and writers: tables, file catalogs, rasters, configuration."""
