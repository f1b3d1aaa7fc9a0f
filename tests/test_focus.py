"""The focus queries ask for converged ranks."""


def test_focus_queries_run_to_convergence(monkeypatch):
    import inspect

    from graphloom.operators import focus, rank
    from graphloom.plans import catalog_queries as q

    asked = []

    def record(of):
        def call(*args, **options):
            given = inspect.signature(of).bind(*args, **options)
            given.apply_defaults()
            asked.append((given.arguments["max_iter"], given.arguments["tol"]))
            raise StopIteration

        return call

    monkeypatch.setattr(q, "catalog_graph", lambda spark, sf_dir: None)
    monkeypatch.setattr(focus, "focus_nodes", record(focus.focus_nodes))
    monkeypatch.setattr(rank, "pagerank", record(rank.pagerank))
    for name in ("focus_global", "focus_personalised", "focus_recency", "god_nodes_converged"):
        try:
            q.queries()[name](None, "")
        except StopIteration:
            pass
    assert asked == [(100, 1e-9)] * 4
