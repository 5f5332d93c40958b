"""Point clustering for Spark DataFrames: cells by geohash, merged greedily within a radius that depends on map zoom."""
