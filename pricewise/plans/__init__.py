"""Join helpers and the end-to-end analyses composed from the operators."""
