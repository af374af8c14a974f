"""leafmill sources."""
