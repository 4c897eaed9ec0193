"""Column to Column functions and the rule tables they are built from."""
