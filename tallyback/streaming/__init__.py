"""Every input and output of this engine is a batch table; there are no streams."""
