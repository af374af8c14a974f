"""leafmill: document analytics expressed as Spark DataFrame operators."""
