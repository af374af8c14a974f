"""leafmill streaming."""
