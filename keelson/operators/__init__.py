"""Reading operators: predicates, scans, cursors, leaf statistics."""
