"""Source text to facts: one language front end each, one control-flow builder for all."""
