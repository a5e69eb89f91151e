"""DataFrame operators: ``op(df, ..., **params) -> DataFrame``."""
