"""See README for the operator map."""
