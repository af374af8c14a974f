"""leafmill functions."""
