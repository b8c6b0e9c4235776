"""Weighted event aggregates on Spark: selection, fills, blocks, merging, reweighting."""
