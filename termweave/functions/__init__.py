"""Column functions: cleaning, n-grams, tokens, vectors, prompts."""
