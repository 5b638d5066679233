"""Column functions: text, replies, numbers and messages."""
