"""Column helpers and the distribution functions of fitted models."""
