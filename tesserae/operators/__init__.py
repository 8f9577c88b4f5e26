"""Array operators: lazy, each returns a new array over the same or a joined base."""
