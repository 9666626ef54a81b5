"""Named analytics plans: each is ``fn(T, **params) -> DataFrame`` over the cleaned table set."""
