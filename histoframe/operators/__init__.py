"""Operators on cells, masks, regions, tiles and clusters, as DataFrame jobs."""
