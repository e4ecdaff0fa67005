"""DataFrame operators. Every function is lazy and returns an unevaluated DataFrame."""
