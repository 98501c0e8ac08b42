"""Column functions: time, names and labels, numbers, line formats."""
