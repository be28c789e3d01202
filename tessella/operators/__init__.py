"""DataFrame operators: ranks, deals, intervals, islands, grids, clusters."""
