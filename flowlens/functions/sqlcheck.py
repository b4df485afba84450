"""What a piece of SQL text may hold, decided on its parsed form."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Nodes that run programs or read anything but a named view.
REFUSED_NODES = (
    "ScriptTransform", "Command", "InsertInto", "UnresolvedTableValuedFunction", "RelationTimeTravel",
    "UnresolvedIdentifier", "ExecuteImmediate",
)
# The groups of built-in functions that compute on their arguments alone, and single ones beside them.
ALLOWED_GROUPS = frozenset((
    "agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs",
    "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs",
    "predicate_funcs", "string_funcs", "struct_funcs", "window_funcs",
))
ALLOWED_FUNCTIONS = frozenset(("typeof",))


def _each(sequence):
    it = sequence.iterator()
    while it.hasNext():
        yield it.next()


def _allowed_function(spark: SparkSession, name: str) -> bool:
    """Whether this is a built-in function of an allowed group; functions that a user registered are none."""
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    found = catalyst.analysis.FunctionRegistry.builtin().lookupFunction(catalyst.FunctionIdentifier(name))
    if found.isEmpty():
        return False
    return name in ALLOWED_FUNCTIONS or found.get().getGroup() in ALLOWED_GROUPS


class _Checker:
    """Walks a parsed query; a name is known inside the ``WITH`` that defines it, and nowhere else."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        holder = "org.apache.spark.sql.catalyst.expressions.PlanExpression"
        self.query_holder = spark._jvm.java.lang.Class.forName(holder)

    def plan(self, node, known: frozenset[str]) -> None:
        if node.getClass().getSimpleName() == "UnresolvedWith":
            for pair in _each(node.cteRelations()):
                name = str(pair._1()).lower()
                # an expression sees those before it, and itself only where it may recurse
                self.plan(pair._2(), known | {name} if node.allowRecursion() else known)
                known = known | {name}
        else:
            self.node(node, known)
            for expression in _each(node.expressions()):
                self.expression(expression, known)
            if node.getClass().getSimpleName() == "WithWindowDefinition":
                for window in _each(node.windowDefinitions().values()):
                    self.expression(window, known)
        for child in _each(node.children()):
            self.plan(child, known)

    def expression(self, node, known: frozenset[str]) -> None:
        self.node(node, known)
        for child in _each(node.children()):
            self.expression(child, known)
        if self.query_holder.isInstance(node):
            self.plan(node.plan(), known)

    def node(self, node, known: frozenset[str]) -> None:
        name = node.getClass().getSimpleName()
        if any(word in name for word in REFUSED_NODES):
            raise ValueError(f"not allowed: {name}")
        if name in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = _name_of(node)
            if len(parts) > 1 or not _allowed_function(self.spark, parts[0]):
                raise ValueError(f"not allowed: function {'.'.join(parts)}")
        if name == "UnresolvedRelation":
            parts = [str(p).lower() for p in _each(node.multipartIdentifier())]
            if len(parts) > 1 or parts[0] not in known:
                raise ValueError(f"not allowed: table {'.'.join(parts)}")


def _name_of(node) -> list[str]:
    if node.getClass().getSimpleName() == "UnresolvedFunction":
        return [str(p).lower() for p in _each(node.nameParts())]
    return str(node.name().unquotedString()).lower().split(".")


def check_query(spark: SparkSession, text: str, views: tuple[str, ...]) -> None:
    """Refuse a query with other tables than ``views``, programs, changes, or functions that are not allowed."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    _Checker(spark).plan(plan, frozenset(views))


def check_expression(spark: SparkSession, text: str) -> None:
    """Refuse a condition with a subquery on any table, or with functions that are not allowed."""
    parsed = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    _Checker(spark).expression(parsed, frozenset())
