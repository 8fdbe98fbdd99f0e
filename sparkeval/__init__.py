"""Data work around training and evaluating reasoning models, as Spark DataFrame operators."""
