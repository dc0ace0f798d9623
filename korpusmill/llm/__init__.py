"""Training-data operators on text and labels; nothing outside this subpackage imports it."""
