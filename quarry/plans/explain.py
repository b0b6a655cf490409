"""EXPLAIN: the physical plan that runs, and the optimiser's estimates where it has any."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

NAMES = {"FileScan": "SEQ_SCAN", "Scan": "SEQ_SCAN", "LocalTableScan": "SEQ_SCAN", "BatchScan": "SEQ_SCAN", "BroadcastHashJoin": "HASH_JOIN", "ShuffledHashJoin": "HASH_JOIN", "SortMergeJoin": "HASH_JOIN", "BroadcastNestedLoopJoin": "NESTED_LOOP_JOIN", "CartesianProduct": "NESTED_LOOP_JOIN", "HashAggregate": "AGGREGATE", "SortAggregate": "AGGREGATE", "ObjectHashAggregate": "AGGREGATE", "Filter": "FILTER", "Project": "PROJECT", "Sort": "SORT", "TakeOrderedAndProject": "TOP_K"}
#: Nodes that only carry rows to the next.
THROUGH = {"WholeStageCodegen", "InputAdapter", "ColumnarToRow", "AQEShuffleRead", "ShuffleQueryStage", "BroadcastQueryStage", "AdaptiveSparkPlan", "BroadcastExchange", "Exchange", "ReusedExchange", "Project"}


def _children(node) -> list:
    name = node.nodeName().split(" (")[0].split("(")[0].strip()
    if name == "AdaptiveSparkPlan":
        return [node.executedPlan()]
    if name.endswith("QueryStage"):
        return [node.plan()]
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _estimate(plan) -> tuple[int | None, int | None]:
    """Rows and bytes of a logical plan."""
    stats = plan.stats()
    count = stats.rowCount()
    return (int(str(count.get())) if count.isDefined() else None), int(str(stats.sizeInBytes()))


def explain_plan(df: DataFrame) -> dict[str, Any]:
    """operation, estimated_rows, cost, details, children of the executed plan. Costs are the bytes that the optimiser expects."""
    execution = df._jdf.queryExecution()
    count, size = _estimate(execution.optimizedPlan())

    def tree(node) -> dict[str, Any]:
        name = node.nodeName().split(" (")[0].split("(")[0].strip().split(" ")[0]
        children = _children(node)
        while name in THROUGH and len(children) == 1:
            node, children = children[0], _children(children[0])
            name = node.nodeName().split(" (")[0].split("(")[0].strip().split(" ")[0]
        logical = node.logicalLink()
        rows, cost = _estimate(logical.get()) if logical.isDefined() else (None, None)
        return {"operation": NAMES.get(name, name.upper()), "estimated_rows": rows, "cost": cost, "details": {"node": name, "text": node.simpleString(120)}, "children": [tree(c) for c in children]}

    top = tree(execution.executedPlan())
    return top | {"estimated_rows": top["estimated_rows"] if top["estimated_rows"] is not None else count, "cost": top["cost"] if top["cost"] is not None else size}
