"""Refuse a query text by its analysed plan: what it reads and what it calls, under any spelling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from claimcheck.functions.guard import standard_literals
from claimcheck.session import DATA_VIEW, ClaimSession

# Leaves that read no table; a reference to a CTE leads back into the text itself.
LEAVES = ["OneRowRelation", "LocalRelation", "CTERelationRef"]
# Expressions and nodes that run code outside Spark SQL.
CODE = re.compile(r"Reflect|UDF|UDAF|ScriptTransformation|Command")


class RefusedQuery(ValueError):
    """A text that reads or calls more than evidence may."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def plan_refusal(plan) -> str | None:
    """Why an analysed plan is refused: it may read the view `data` and its own CTEs only, and no code."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = _kind(node)
        if CODE.search(kind):
            return f"disallowed in a query: {kind}"
        if kind == "View":
            name = node.desc().identifier().unquotedString()
            if not node.isTempView() or name.lower() != DATA_VIEW:
                return f"disallowed relation in query: {name}; only read the `{DATA_VIEW}` view"
            continue
        expressions = _items(node.expressions())
        while expressions:
            expression = expressions.pop()
            if CODE.search(_kind(expression)):
                return f"disallowed function in query: {expression.prettyName()}"
            expressions += _items(expression.children())
        below = [*_items(node.children()), *_items(node.subqueries())]
        if not below and kind not in LEAVES:
            return f"disallowed relation in query: {kind}; only read the `{DATA_VIEW}` view"
        todo += below
    return None


def checked_sql(session: ClaimSession, query: str) -> DataFrame:
    """The DataFrame of a text whose plan is accepted. The plan is analysed first; nothing runs until then."""
    text = standard_literals(query)
    state = session.spark._jsparkSession.sessionState()
    refusal = plan_refusal(state.analyzer().execute(state.sqlParser().parsePlan(text)))
    if refusal is not None:
        raise RefusedQuery(refusal)
    return session.spark.sql(text)
