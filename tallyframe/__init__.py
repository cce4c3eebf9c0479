"""Profiling, exploration, class balancing and classification of wide coded tables on Spark."""
