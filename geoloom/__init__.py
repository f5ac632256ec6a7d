"""Geographic feature tables on stock Spark: conflation, rasters, profiles, area algebra, live observations."""
