"""Land-cover analytics as DataFrames: rasters are tables of pixels, and every analysis is a query."""
