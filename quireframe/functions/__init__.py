"""Column functions and grammars."""
