"""Fleet-scale health analytics for Spark applications, expressed as DataFrame operators."""
