"""leafmill plans."""
