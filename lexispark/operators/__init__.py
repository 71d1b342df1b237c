"""Index, search, scoring, evaluation and learning."""
