"""leafmill operators."""
