"""Card-transaction analytics on Spark: validation, velocity features, star schema, views and panels."""
