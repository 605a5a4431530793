"""Driver-side plan objects: schemas, calls and stages."""
