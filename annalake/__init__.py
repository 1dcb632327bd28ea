"""annalake: historised warehouse operators as plain Spark DataFrame jobs."""
