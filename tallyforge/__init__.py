"""Code-portfolio analytics as Spark DataFrame jobs."""
