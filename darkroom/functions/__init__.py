"""Column functions, and the numpy functions that pixel data needs."""
