"""Column functions: text, time, numbers and label maps."""
