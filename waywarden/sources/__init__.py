"""Where points and map layers come from."""
