"""Planar Boolean geometry over tables of axis-aligned integer contours, as Spark plans."""
