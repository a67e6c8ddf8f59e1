"""Options, choice of a projection, registered queries and the benchmark."""
