"""Query plans: the adapted TPC-H set."""
