"""Document and code intelligence as Spark DataFrame transformations."""
