"""Column expressions: text keys, phonetic keys, content ids."""
