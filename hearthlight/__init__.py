"""Community-forum wellness and safety analytics as Spark DataFrame operators."""
