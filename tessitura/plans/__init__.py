"""Named plans over the generic operators."""
