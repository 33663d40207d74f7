"""Writers and their projections."""
