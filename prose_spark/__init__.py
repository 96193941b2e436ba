"""prose_spark: prose analytics as DataFrame-to-DataFrame operators."""
