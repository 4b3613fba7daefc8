"""DataFrame operators: numbering, joins, folds, grids, metrics."""
