"""barloom: cross-sectional market research as Spark DataFrame operators."""
