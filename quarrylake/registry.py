"""All queries of the library, by name, and their SQL."""

from quarrylake.plans import catalog_queries, evaluation_queries, further_queries, report_queries, resampling_queries, volume_queries

_ALL = {**report_queries.Q, **evaluation_queries.Q, **catalog_queries.Q, **further_queries.Q, **resampling_queries.Q, **volume_queries.Q}


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
