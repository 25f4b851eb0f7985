"""Front end: text of logic rules to a tree of rules."""
