"""tidemark: customer-activity analytics as Spark DataFrame plans."""
