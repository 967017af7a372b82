"""The same questions asked of streams."""
