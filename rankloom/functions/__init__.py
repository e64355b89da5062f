"""Column functions on texts, references and vectors."""
