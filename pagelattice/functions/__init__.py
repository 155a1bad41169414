"""Column functions: geometry, PAGE attributes, scores."""
