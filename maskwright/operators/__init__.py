"""Column and table operators: scanning, masking, sanitizing."""
