"""geoloom: vector and raster analytics expressed in Spark DataFrames."""
