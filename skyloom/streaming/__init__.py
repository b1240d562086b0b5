"""Grids and histograms of streams."""
