"""Jobs, views and panels composed of the operators."""
