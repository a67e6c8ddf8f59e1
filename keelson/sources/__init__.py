"""Building and opening covering projections."""
