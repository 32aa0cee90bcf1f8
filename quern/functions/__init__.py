"""User-defined functions over Arrow batches, for what built-in functions can't say."""
