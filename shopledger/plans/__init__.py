"""Building blocks shared by the operators: pinned tables, range placement, distributions."""
