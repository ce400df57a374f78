"""Product-deal analytics as DataFrame-to-DataFrame jobs on Apache Spark."""
