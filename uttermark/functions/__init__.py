"""Column functions: text, parameters, errors, numbers, signals."""
