"""What a plan's joins made, read from its metrics after it has run."""


def join_rows(df):
    """The most rows that a join of ``df`` gives, or that a projection leaves of them; ``df`` is collected for that."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name:
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return most
