"""Column expressions: interpolation, lattice noise, names, projections."""
