"""Training-data operators over the text tables. Nothing outside this subpackage imports it."""
