"""How data moves: which columns of which tables a view's or a statement's columns come from, read from
Spark's analysed plans, and what follows over several steps.

A plan names each column by an expression id. An alias gives a new id to what its expression refers to; set operations and
generators give new ids by place; a view or a table ends the walk. So lineage needs no parser, and holds for anything that
Spark analyses: temporary views, tables, inserts, tables created from queries. Plans are small; they are read on the driver.
The closure over links is a join that goes on with what is new, on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.stored import stored

LINKS = "from_table string, from_column string, to_table string, to_column string, kind string, via string"
MOST_STEPS = 64
#: Expressions with a plan of their own.
_SUBQUERIES = ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery")


def _items(scala) -> Iterator:
    it = scala.iterator()
    while it.hasNext():
        yield it.next()


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _ids(attributes) -> list[int]:
    return [a.exprId().id() for a in _items(attributes)]


class _Walk:
    """sources: the columns (table, column) that an expression id stands for, as far as walked."""

    def __init__(self, own: str | None = None):
        self.own, self.sources, self.reads, self.ctes = own, {}, set(), {}

    def leaf(self, name: str, output) -> None:
        self.reads.add(name)
        for a in _items(output):
            self.sources.setdefault(a.exprId().id(), set()).add((name, a.name()))

    def of(self, expression) -> set:
        out = set()
        for i in _ids(expression.references()):
            out |= self.sources.get(i, set())
        for sub in self.subqueries(expression):
            self.plan(sub.plan())
            for a in _ids(sub.plan().output()):
                out |= self.sources.get(a, set())
        return out

    @classmethod
    def subqueries(cls, expression) -> list:
        found = [expression] if _kind(expression) in _SUBQUERIES else []
        for child in _items(expression.children()):
            found += cls.subqueries(child)
        return found

    def plan(self, node) -> None:
        kind = _kind(node)
        if kind == "SubqueryAlias":
            child, name = node.child(), ".".join([*_items(node.identifier().qualifier()), node.identifier().name()])
            # a named view or table ends the walk; an alias of a query does not
            if _kind(child) == "View" or not child.children().nonEmpty() and _kind(child) not in ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef"):
                named = child.desc().identifier().table() if _kind(child) == "View" else name.split(".")[-1]
                if named != self.own:
                    self.leaf(named, node.output())
                    return
        if kind == "View" and node.desc().identifier().table() != self.own:
            self.leaf(node.desc().identifier().table(), node.output())
            return
        for child in _items(node.children()):
            self.plan(child)
        if kind == "CTERelationDef":
            self.ctes[node.id()] = _ids(node.output())
        if kind == "CTERelationRef":
            for a, b in zip(_ids(node.output()), self.ctes.get(node.cteId(), [])):
                self.sources[a] = self.sources.get(b, set())
            return
        if kind in ("Union", "Intersect", "Except"):
            kids = list(_items(node.children()))
            for child in kids if kind == "Union" else kids[:1]:
                for a, b in zip(_ids(node.output()), _ids(child.output())):
                    self.sources[a] = self.sources.get(a, set()) | self.sources.get(b, set())
            return
        if kind == "View":
            for a, b in zip(_ids(node.output()), _ids(node.child().output())):
                self.sources[a] = self.sources.get(b, set())
            return
        if kind == "Generate":
            of = self.of(node.generator())
            for a in _ids(node.generatorOutput()):
                self.sources[a] = set(of)
            return
        if kind == "Expand":
            rows = [list(_items(p)) for p in _items(node.projections())]
            for i, a in enumerate(_ids(node.output())):
                # a column that stands for itself in one of the rows is named by its place
                self.sources[a] = self.sources.get(a, set()).union(*(self.of(r[i]) for r in rows))
            return
        for e in _items(node.expressions()):
            self.named(e)

    def named(self, expression) -> None:
        if _kind(expression) == "Alias":
            self.sources[expression.exprId().id()] = self.of(expression.child())
        elif self.subqueries(expression):
            self.of(expression)  # what a filter reads


def _analysed(spark: SparkSession, sql: str):
    session = spark._jsparkSession
    return session.sessionState().executePlan(session.sessionState().sqlParser().parsePlan(sql), spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()


def _rows(walk: _Walk, output, to: str, columns: list[str], kind: str, via: str) -> list[tuple]:
    links = {(t, c, to, own, kind, via) for a, own in zip(_ids(output), columns) for t, c in walk.sources.get(a, set()) if t != to}
    read = {r[0] for r in links}
    links |= {(t, None, to, None, kind, via) for t in walk.reads - read - {to}}  # read for its rows only
    return sorted(links, key=repr)


def view_links(spark: SparkSession, views: list[str]) -> DataFrame:
    """LINKS of views to what they are made of, the next views or tables: kind `feeds`, via the view. A table that only
    decides which rows there are has a link without columns."""
    out = []
    for name in views:
        plan, walk = _analysed(spark, f"SELECT * FROM `{name}`"), _Walk(name)
        walk.plan(plan)
        out += _rows(walk, plan.output(), name, [a.name() for a in _items(plan.output())], "feeds", f"view {name}")
    return spark.createDataFrame(out, LINKS)


def statement_links(spark: SparkSession, statements: list[str]) -> DataFrame:
    """LINKS of statements that insert into tables or create them from queries, without running them: kind `writes`."""
    out = []
    for number, sql in enumerate(statements, 1):
        plan = _analysed(spark, sql)
        query = next((getattr(plan, m)() for m in ("query", "source") if m in dir(plan)), None)
        if query is None or not plan.children().nonEmpty() and "query" not in dir(plan):
            continue
        target, columns = _target(plan), [a.name() for a in _items(query.output())]
        if target is None:
            continue
        names, to = target
        walk = _Walk()
        walk.plan(query)
        out += _rows(walk, query.output(), to, names or columns, "writes", f"statement {number}")
    return spark.createDataFrame(out, LINKS)


def _target(plan) -> tuple[list[str], str] | None:
    """The written columns (if known) and the table of a plan that writes."""
    methods = dir(plan)
    if "catalogTable" in methods:
        table = plan.catalogTable()
        table = table.get() if "get" in dir(table) else table
        return ([f.name() for f in table.schema().fields()] if "schema" in dir(table) else []), table.identifier().table()
    if "tableDesc" in methods:
        return [], plan.tableDesc().identifier().table()
    if "table" in methods:
        relation = plan.table()
        if "identifier" in dir(relation):  # a table that is to be created
            return [], relation.identifier().table()
        if "output" in dir(relation):
            return [a.name() for a in _items(relation.output())], relation.name().split(".")[-1] if "name" in dir(relation) else relation.toString()
    if "name" in methods and "nameParts" in dir(plan.name()):
        return [], list(_items(plan.name().nameParts()))[-1]
    return None


def closure(links: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """source, target, steps: all that leads to something over links (source, target), and by how few of them. Each step
    joins the links only with what the last one found new; cycles end, as no pair is new twice."""
    links = stored(links.select("source", "target").where("source <> target").distinct(), "lineage-links")
    known = new = links.withColumn("steps", F.lit(1))
    for step in range(2, most + 2):
        found = new.select("source", F.col("target").alias("via")).join(links.select(F.col("source").alias("via"), "target"), "via").select("source", "target").where("source <> target").distinct()
        new = stored(found.join(known.select("source", "target"), ["source", "target"], "left_anti").withColumn("steps", F.lit(step)), "lineage-new")
        if new.limit(1).count() == 0:
            return known
        known = stored(known.unionByName(new), "lineage-known")
    raise RuntimeError(f"paths are longer than {most} links")


def due(keys: DataFrame, scanned: DataFrame, now, days: int = 7, budget: int = 6) -> DataFrame:
    """Of tables (key, place) that were used those to read next, in order: not read (key, at) in the last days, `budget` at most."""
    fresh = scanned.where(F.col("at") > F.lit(now) - F.make_dt_interval(F.lit(days)))
    return keys.groupBy("key").agg(F.min("place").alias("place")).join(fresh.select("key"), "key", "left_anti").orderBy("place").limit(budget).select("key")


def domains_of(domains: DataFrame) -> DataFrame:
    """table, place, path: the domains of each table, from domains (path, tables, rank: how much their source is trusted): the
    most trusted first, then the deepest path (its parts are apart by ' › '), then by name."""
    from pyspark.sql.window import Window

    depth = F.size(F.split("path", " › "))
    rows = domains.select(F.explode(F.array_distinct("tables")).alias("table"), "path", "rank", depth.alias("depth"))
    order = Window.partitionBy("table").orderBy(F.desc("rank"), F.desc("depth"), "path")
    return rows.select("table", F.row_number().over(order).alias("place"), "path")
