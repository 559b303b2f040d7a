"""Reports, evaluation and the registered queries."""
