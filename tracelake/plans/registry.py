"""Where the modules of this package put their queries: a function of (spark, sf_dir) and SQL with the same rows."""

from .bindings import with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; sql may use the views of bindings."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return put
