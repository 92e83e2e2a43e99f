"""Writers, merges, consolidation and publication of the tables."""
