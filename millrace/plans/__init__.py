"""Plans: the catalogue of queries, views and their planner."""


def load() -> None:
    """Import the modules that register queries."""
    from millrace.plans import q_analytics, q_graph, q_mining, q_relational, q_results, q_scans, q_sources  # noqa: F401
