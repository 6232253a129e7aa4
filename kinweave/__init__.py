"""Entity-family fusion on Spark: control log + source reports -> family records."""
