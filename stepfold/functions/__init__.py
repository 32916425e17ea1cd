"""Column functions: text normalisation, protocol values, JSON tokens, scores."""
