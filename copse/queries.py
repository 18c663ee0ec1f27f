"""The engine's queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse import catalog
from copse.functions.cnf import Ref
from copse.functions.interval import Label
from copse.operators import relational as rel
from copse.operators import structural, witness
from copse.plans.pattern import Pattern, Rule
from copse.plans.planner import match, tag_counts
from copse.plans.query import Query, execute
from copse.sources import layout, table
from copse.sources.relational import chat_tree, geo_tree, sales_tree, xml_customers, xml_regions
from copse.sources.xml import shred

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TREES = {"sales": sales_tree, "geo": geo_tree, "chat": chat_tree, "xml_customers": xml_customers, "xml_regions": xml_regions}

# SQL of the trees ------------------------------------------------------------------------------------------------
#
# Labels in closed form: with the sizes of what comes before it, a node's start and end follow from its place among its
# siblings, so a tree is a few small aggregates and unions. No node meets another one here.

_ROWS = {
    "sales": """
ln AS (SELECT l_orderkey, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_returnflag NULLS FIRST) AS j FROM lineitem),
counted AS (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY l_orderkey),
sized AS (SELECT o_custkey AS doc_id, o_orderkey AS o, o_orderstatus AS status, o_orderpriority AS priority, 3 + 2 * coalesce(lines, 0) AS size,
            CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS up
          FROM orders LEFT JOIN counted ON o_orderkey = k LEFT JOIN customer ON o_custkey = c_custkey),
ord AS (SELECT *, 4 * up + 2 * (sum(size) OVER (PARTITION BY doc_id ORDER BY o) - size) AS s FROM sized),
whole AS (SELECT doc_id AS d, sum(size) AS below FROM sized GROUP BY doc_id),
made(doc_id, s, e, level, tag, up) AS (
  SELECT c_custkey, 1, 2 * (2 + coalesce(below, 0)), 1, 'customer', 0 FROM customer LEFT JOIN whole ON c_custkey = d
  UNION ALL SELECT c_custkey, 2, 3, 2, 'segment=' || c_mktsegment, 1 FROM customer
  UNION ALL SELECT doc_id, s, s + 2 * size - 1, 2, 'order', up FROM ord
  UNION ALL SELECT doc_id, s + 1, s + 2, 3, 'status=' || status, s FROM ord
  UNION ALL SELECT doc_id, s + 3, s + 4, 3, 'priority=' || priority, s FROM ord
  UNION ALL SELECT doc_id, s + 1 + 4 * j, s + 4 + 4 * j, 3, 'line', s FROM ord JOIN ln ON o = l_orderkey
  UNION ALL SELECT doc_id, s + 2 + 4 * j, s + 3 + 4 * j, 4, 'flag=' || flag, s + 1 + 4 * j FROM ord JOIN ln ON o = l_orderkey),
""",
    "geo": """
ranked AS (SELECT n_regionkey AS r, n_name, 4 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation),
counted AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey),
made(doc_id, s, e, level, tag, up) AS (
  SELECT r_regionkey, 1, 4 + 4 * coalesce(n, 0), 1, 'region', 0 FROM region LEFT JOIN counted ON r_regionkey = k
  UNION ALL SELECT r_regionkey, 2, 3, 2, r_name, 1 FROM region
  UNION ALL SELECT r, s, s + 3, 2, 'nation', 1 FROM ranked
  UNION ALL SELECT r, s + 1, s + 2, 3, n_name, s FROM ranked),
""",
    "chat": """
ranked AS (SELECT conv_id AS c, coalesce(role, '') AS role, 4 * row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 2 AS s FROM conversations),
made(doc_id, s, e, level, tag, up) AS (
  SELECT c, 1, 2 + 4 * count(*), 1, 'chat', 0 FROM ranked GROUP BY c
  UNION ALL SELECT c, s, s + 3, 2, 'turn', 1 FROM ranked
  UNION ALL SELECT c, s + 1, s + 2, 3, role, s FROM ranked),
""",
    # <customer><segment>S</segment><order status="F"><priority>P</priority></order>...</customer>, names and texts cut to five
    "xml_customers": """
ord AS (SELECT o_custkey AS c, left(o_orderstatus, 5) AS status, left(o_orderpriority, 5) AS priority, 10 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 4 AS s FROM orders),
counted AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey),
made(doc_id, s, e, level, tag, up) AS (
  SELECT c_custkey, 1, 6 + 10 * coalesce(n, 0), 1, 'customer', 0 FROM customer LEFT JOIN counted ON c_custkey = k
  UNION ALL SELECT c_custkey, 2, 5, 2, 'segme', 1 FROM customer
  UNION ALL SELECT c_custkey, 3, 4, 3, left(c_mktsegment, 5), 2 FROM customer
  UNION ALL SELECT c, s, s + 9, 2, 'order', 1 FROM ord
  UNION ALL SELECT c, s + 1, s + 4, 3, 'statu', s FROM ord
  UNION ALL SELECT c, s + 2, s + 3, 4, status, s + 1 FROM ord
  UNION ALL SELECT c, s + 5, s + 8, 3, 'prior', s FROM ord
  UNION ALL SELECT c, s + 6, s + 7, 4, priority, s + 5 FROM ord),
""",
    # <region><name>R</name><nation><name>N</name></nation>...</region>
    "xml_regions": """
ranked AS (SELECT n_regionkey AS r, left(n_name, 5) AS name, 6 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation),
counted AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey),
made(doc_id, s, e, level, tag, up) AS (
  SELECT r_regionkey, 1, 6 + 6 * coalesce(n, 0), 1, 'region', 0 FROM region LEFT JOIN counted ON r_regionkey = k
  UNION ALL SELECT r_regionkey, 2, 5, 2, 'name', 1 FROM region
  UNION ALL SELECT r_regionkey, 3, 4, 3, left(r_name, 5), 2 FROM region
  UNION ALL SELECT r, s, s + 5, 2, 'natio', 1 FROM ranked
  UNION ALL SELECT r, s + 1, s + 4, 3, 'name', s FROM ranked
  UNION ALL SELECT r, s + 2, s + 3, 4, name, s + 1 FROM ranked),
""",
}
_NODES = """nodes AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", CAST(level AS INTEGER) AS level, tag, CAST(up AS INTEGER) AS parent_start FROM made)
"""


def tree_sql(tree: str, body: str) -> str:
    return f"WITH {_ROWS[tree].strip()}\n{_NODES}{body}"


def _side(tag: str, name: str) -> str:
    where = "" if tag == "*" else f" WHERE tag = '{tag}'"
    return f'(SELECT doc_id, "start", "end", level, tag FROM nodes{where}) {name}'


def twig_sql(pattern: Pattern, reverse: bool = False) -> str:
    """A pattern as joins of its nodes' candidates, filtered by tag first, in binding order: equal documents, and containment."""
    names = {i: f"n{i}" for i in range(1, len(pattern.tags) + 1)}

    def holds(r: Rule) -> str:
        a, d = names[r.upper], names[r.lower]
        return f'{a}."start" < {d}."start" AND {a}."end" > {d}."end"' + (f" AND {d}.level = {a}.level + 1" if r.axis == "PC" else "")

    order = pattern.binding(reverse)
    joined, left = _side(pattern.tags[order[0] - 1], names[order[0]]), list(pattern.rules)
    for k, n in enumerate(order[1:], 1):
        ready = [r for r in left if {r.upper, r.lower} <= set(order[: k + 1])]
        left = [r for r in left if r not in ready]
        joined += f"\n JOIN {_side(pattern.tags[n - 1], names[n])} ON {' AND '.join([f'{names[order[0]]}.doc_id = {names[n]}.doc_id', *map(holds, ready)])}"
    columns = [f'{names[n]}."{p}" AS {p}_{k}' for k, n in enumerate(order, 1) for p in ("start", "end", "level", "tag")]
    return f"SELECT {names[order[0]]}.doc_id, {', '.join(columns)} FROM {joined}"


def pattern(tags: str, *rules: str) -> Pattern:
    return Pattern(tuple(tags.split()), tuple(Rule(int(a), int(b), x) for a, b, x in (r.split() for r in rules)))


def nodes(spark: SparkSession, sf_dir: str, tree: str = "sales") -> DataFrame:
    return layout.load_once(spark, tree, sf_dir, TREES[tree])


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _register(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    run.__name__ = name
    query(sql)(run)


_FIVE = 'doc_id, "start", "end", level, tag'


def five(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", "end", "level", "tag")


def six(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "start", "end", "level", "tag", F.coalesce("parent_start", F.lit(0)).alias("parent_start"))


# Labels and look-ups ---------------------------------------------------------------------------------------------


@query(tree_sql("sales", f"SELECT {_FIVE}, parent_start FROM nodes"))
def label_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with its parent's start, 0 for roots."""
    return six(sales_tree(spark, sf_dir))


@query(tree_sql("sales", f"SELECT {_FIVE} FROM nodes WHERE tag = 'order'"))
def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.by_tag(nodes(spark, sf_dir), "order"))


@query(tree_sql("sales", f"SELECT {_FIVE} FROM nodes WHERE lower(tag) = 'segment=building'"))
def tag_scan_ignore_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.by_tag(nodes(spark, sf_dir), "Segment=Building", ignore_case=True))


@query(tree_sql("sales", f"SELECT {_FIVE} FROM nodes WHERE tag >= 'flag=A' AND tag <= 'flag=N'"))
def tag_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.by_tag_range(nodes(spark, sf_dir), "flag=A", "flag=N"))


@query(tree_sql("sales", f'SELECT {_FIVE} FROM nodes WHERE "start" BETWEEN 10 AND 40'))
def interval_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.scan(nodes(spark, sf_dir), F.col("start").between(10, 40)))


@query(tree_sql("sales", f"SELECT {_FIVE} FROM nodes WHERE doc_id = 7 AND \"start\" > 1 AND \"end\" < 1000000 AND level = 2 AND tag = 'order'"))
def interval_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.by_interval(nodes(spark, sf_dir), Label.literal(7, 1, 1_000_000, 1), "child", "order"))


@query(tree_sql("sales", f'SELECT {_FIVE} FROM nodes WHERE doc_id = 7 AND "start" > 1 AND "end" < 1000000'))
def interval_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(layout.by_interval(nodes(spark, sf_dir), Label.literal(7, 1, 1_000_000, 1)))


@query(tree_sql("sales", "SELECT tag FROM nodes"))
def index_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.index_only(nodes(spark, sf_dir), "tag")


@query(tree_sql("sales", "SELECT tag, count(*) AS n FROM nodes GROUP BY tag"))
def tag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"))


@query(tree_sql("sales", f"SELECT {_FIVE} FROM nodes"))
def tag_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows in the order of their tags: what a scan of the tag index without a bound gives."""
    return five(layout.in_tag_order(nodes(spark, sf_dir)))


@query(tree_sql("sales", f'SELECT {_FIVE} FROM nodes WHERE doc_id BETWEEN 5 AND 60 AND "start" BETWEEN 4 AND 30'))
def interval_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of documents and starts from the layout by interval, whose sorted files are skipped by their statistics."""
    found = layout.load_once(spark, "sales", sf_dir, TREES["sales"], "interval")
    return five(layout.scan(found, F.col("doc_id").between(5, 60) & F.col("start").between(4, 30)))


@query(
    tree_sql(
        "sales",
        """, pairs AS (SELECT count(*) FILTER (d.level = a.level + 1) AS near, count(*) FILTER (d.level > a.level + 1) AS far
           FROM (SELECT * FROM nodes WHERE "end" > "start" + 1) a JOIN nodes d ON a.doc_id = d.doc_id AND a."start" < d."start" AND a."end" > d."end"),
per AS (SELECT count(*) AS n FROM nodes GROUP BY doc_id), total AS (SELECT CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(n * n) AS BIGINT) AS squares FROM per)
SELECT code, n FROM (
  SELECT 9 AS code, near AS n FROM pairs UNION ALL SELECT 10, near FROM pairs UNION ALL SELECT 1, far FROM pairs UNION ALL SELECT 2, far FROM pairs
  UNION ALL SELECT 4, nodes FROM total UNION ALL SELECT 0, squares - nodes - 2 * (near + far) FROM total, pairs) WHERE n > 0""",
    )
)
def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ordered pairs of nodes of one document, on all levels, have each interval relation."""
    return relation_counts(nodes(spark, sf_dir))


def relation_counts(tree: DataFrame) -> DataFrame:
    """(code, n) of the ordered pairs of nodes of each document, without pairs: a node has a parent at most, its list of
    ancestors and itself, and what is left of a document's pairs is disjoint. Codes without a pair have no row."""
    up = F.col("parent_start").isNotNull().cast("long")
    by_doc = tree.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(up).alias("parents"), F.sum(F.size("ancestors").cast("long") - up).alias("far"))
    disjoint = F.col("n") * F.col("n") - F.col("n") - 2 * (F.col("parents") + F.col("far"))
    counts = {0: disjoint, 1: F.col("far"), 2: F.col("far"), 4: F.col("n"), 9: F.col("parents"), 10: F.col("parents")}
    one = by_doc.agg(*[F.sum(c).alias(f"n_{code}") for code, c in counts.items()])
    rows = F.array(*[F.struct(F.lit(code).alias("code"), F.col(f"n_{code}").alias("n")) for code in counts])
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


# Structural joins ------------------------------------------------------------------------------------------------



def _pairs(name: str, upper: str, lower: str, axis: str, strategy: str) -> None:
    sql = twig_sql(Pattern((upper, lower), (Rule(1, 2, axis),)))
    _register(name, lambda spark, sf_dir: structural.pairs(nodes(spark, sf_dir), upper, lower, axis, strategy), tree_sql("sales", sql))


for _strategy in structural.STRATEGIES:
    _pairs(f"pc_join_{_strategy}", "customer", "order", "PC", _strategy)
    _pairs(f"ad_join_{_strategy}", "customer", "flag=R", "AD", _strategy)

_EIGHT = ", ".join(f'n{i}."{p}" AS {p}_{i}' for i in (1, 2) for p in ("start", "end", "level", "tag"))


@query(tree_sql("sales", f'SELECT n1.doc_id, {_EIGHT} FROM (SELECT * FROM nodes WHERE level = 2) n1 JOIN (SELECT * FROM nodes WHERE tag = \'order\') n2 ON n1.doc_id = n2.doc_id AND n1."start" = n2."start" AND n1."end" = n2."end"'))
def same_node_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = nodes(spark, sf_dir)
    return structural.node_pairs(tree.filter("level = 2"), layout.by_tag(tree, "order"))


# Twigs -----------------------------------------------------------------------------------------------------------

CHAIN = pattern("customer order line flag=R", "1 2 PC", "2 3 PC", "3 4 PC")
BRANCH = pattern("customer order status=F flag=R", "1 2 AD", "2 3 PC", "2 4 AD")
UPWARD = pattern("customer order status=P", "2 3 PC", "1 2 PC")
WILD = pattern("customer * flag=A", "1 2 PC", "2 3 AD")
TWICE = pattern("order flag=R flag=R", "1 2 AD", "1 3 AD")
CYCLE = pattern("customer order flag=A", "1 2 PC", "2 3 AD", "1 3 AD")


def _twig(name: str, p: Pattern, tree: str = "sales", **how) -> None:
    reverse = how.get("reverse", False)
    _register(name, lambda spark, sf_dir: match(nodes(spark, sf_dir, tree), p, **how), tree_sql(tree, twig_sql(p, reverse=reverse)))


_twig("twig_chain", CHAIN)
_twig("twig_chain_labels", CHAIN, strategy="labels")
_twig("twig_branch", BRANCH)
_twig("twig_reverse", BRANCH, reverse=True)
_twig("twig_stitch", BRANCH, stitch=True)
_twig("twig_upward", UPWARD)
_twig("twig_wildcard", WILD)
_twig("twig_repeated_tag", TWICE)
_twig("twig_closing_rule", CYCLE)
_twig("twig_chat", pattern("chat turn assistant", "1 2 PC", "2 3 PC"), "chat")
_twig("twig_single", pattern("customer"))


@query(tree_sql("sales", twig_sql(BRANCH)))
def twig_selective(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = nodes(spark, sf_dir)
    return match(tree, BRANCH, counts=tag_counts(tree, BRANCH.tags))


# Operators over witnesses ----------------------------------------------------------------------------------------

URGENT = pattern("order priority=1-URGENT", "1 2 PC")
FINAL = pattern("order status=F", "1 2 PC")
ORDERS = pattern("customer order *", "1 2 PC", "2 3 PC")
PLACES = pattern("region *", "1 2 AD")
NATIONS = pattern("region nation", "1 2 PC")


def _both(one: Pattern, two: Pattern, on: str, root: str, tree: str) -> str:
    def columns(side: str, p: Pattern) -> str:
        names = ["doc_id", *[f"{x}_{k}" for k in range(1, len(p.tags) + 1) for x in ("start", "end", "level", "tag")]]
        return ", ".join(f"{side}.{c} AS {side}_{c}" for c in names)

    return tree_sql(tree, f', "left" AS ({twig_sql(one)}), "right" AS ({twig_sql(two)}) SELECT {columns("left", one)}, {columns("right", two)}, {root} AS root FROM "left" JOIN "right" ON {on}'.replace("left.", '"left".').replace("right.", '"right".'))


def _complex(name: str, q: Query, sql: str, tree: str = "sales") -> None:
    _register(name, lambda spark, sf_dir: execute(nodes(spark, sf_dir, tree), q), sql)


_complex("cp", Query(NATIONS, PLACES, "CP"), _both(NATIONS, PLACES, "true", "'CP_root'", "geo"), "geo")
_complex("tj", Query(PLACES, PLACES, "TJ", (2, 2)), _both(PLACES, PLACES, "left.tag_2 = right.tag_2", "'TJ_root_' || left.tag_2", "geo"), "geo")
_complex("nj", Query(URGENT, FINAL, "NJ", (1, 1)), _both(URGENT, FINAL, "left.doc_id = right.doc_id AND left.start_1 = right.start_1 AND left.end_1 = right.end_1", "'NJ_root_[' || left.start_1 || ',' || left.end_1 || ']'", "sales"))
_complex("srt", Query(BRANCH, None, "SRT", (3,)), tree_sql("sales", twig_sql(BRANCH)))


def _grouped(tree: str, p: Pattern) -> str:
    return tree_sql(
        tree,
        f", w AS ({twig_sql(p)}), t AS (SELECT tag_3 AS t, count(*) AS group_size, row_number() OVER (ORDER BY tag_3) AS group_no FROM w GROUP BY tag_3) "
        "SELECT w.*, group_size, group_no, row_number() OVER (PARTITION BY tag_3 ORDER BY doc_id, start_1, start_2, start_3) AS member_no FROM w JOIN t ON tag_3 = t",
    )


_complex("grp_members", Query(ORDERS, None, "GRP", (3,)), _grouped("sales", ORDERS))


@query(tree_sql("sales", f", w AS ({twig_sql(ORDERS)}) SELECT tag_3 AS tag, count(*) AS group_size, row_number() OVER (ORDER BY tag_3) AS group_no FROM w GROUP BY tag_3"))
def grp_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return witness.groups(match(nodes(spark, sf_dir), ORDERS), 3)


@query(tree_sql("sales", f"SELECT DISTINCT doc_id, start_1, tag_1 FROM ({twig_sql(BRANCH)})"))
def distinct_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return witness.distinct(match(nodes(spark, sf_dir), BRANCH).select("doc_id", "start_1", "tag_1"))


@query(
    tree_sql(
        "sales",
        f""", w AS ({twig_sql(UPWARD)}), e AS (
SELECT doc_id, start_3 AS "start", end_3 AS "end", level_3 AS level, tag_3 AS tag, 0 AS parent_start FROM w
UNION ALL SELECT doc_id, start_1, end_1, level_1, tag_1, start_3 FROM w UNION ALL SELECT doc_id, start_2, end_2, level_2, tag_2, start_1 FROM w) SELECT * FROM e""",
    )
)
def witness_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each node of each witness, with its parent's start, 0 for roots."""
    return witness.tree_edges(match(nodes(spark, sf_dir), UPWARD)).drop("witness").fillna(0, ["parent_start"])


# Documents written as XML from rows, shredded, stored by folder, and queried ------------------------------------------

XML_ORDERS = pattern("customer order prior 1-URG", "1 2 PC", "2 3 PC", "3 4 PC")
XML_FINAL = pattern("order statu F", "1 2 PC", "2 3 PC")
XML_URGENT = pattern("order prior 1-URG", "1 2 PC", "2 3 PC")
XML_TEXTS = pattern("customer order *", "1 2 PC", "2 3 AD")
XML_PLACES = pattern("region name *", "1 2 AD", "2 3 PC")
XML_NATIONS = pattern("natio name", "1 2 PC")


def _xml(name: str, q: Query, sql: str, tree: str = "xml_customers") -> None:
    _register(name, lambda spark, sf_dir: execute(layout.load_once(spark, tree, sf_dir, TREES[tree], "folder"), q), sql)


@query(tree_sql("xml_customers", f"SELECT {_FIVE}, parent_start FROM nodes"))
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the shredded documents with its parent's start, 0 for roots."""
    return six(xml_customers(spark, sf_dir))


@query(tree_sql("xml_customers", f"SELECT {_FIVE} FROM nodes WHERE tag = '1-URG'"))
def xml_tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text, looked up as a tag."""
    return five(layout.by_tag(layout.load_once(spark, "xml_customers", sf_dir, xml_customers, "folder"), "1-URG"))


_xml("xml_sel", Query(XML_ORDERS), tree_sql("xml_customers", twig_sql(XML_ORDERS)))
_xml("xml_cp", Query(XML_NATIONS, XML_PLACES, "CP"), _both(XML_NATIONS, XML_PLACES, "true", "'CP_root'", "xml_regions"), "xml_regions")
_xml("xml_tj", Query(XML_PLACES, XML_PLACES, "TJ", (3, 3)), _both(XML_PLACES, XML_PLACES, "left.tag_3 = right.tag_3", "'TJ_root_' || left.tag_3", "xml_regions"), "xml_regions")
_xml("xml_nj", Query(XML_URGENT, XML_FINAL, "NJ", (1, 1)), _both(XML_URGENT, XML_FINAL, "left.doc_id = right.doc_id AND left.start_1 = right.start_1 AND left.end_1 = right.end_1", "'NJ_root_[' || left.start_1 || ',' || left.end_1 || ']'", "xml_customers"))
_xml("xml_srt", Query(XML_ORDERS, None, "SRT", (3,)), tree_sql("xml_customers", twig_sql(XML_ORDERS)))
_xml("xml_grp", Query(XML_TEXTS, None, "GRP", (3,)), _grouped("xml_customers", XML_TEXTS))


# Relations -------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND o_orderpriority != '5-LOW' AND o_totalprice >= 1000")
def cnf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses = [[(Ref("o_orderstatus"), "=", "F"), (Ref("o_totalprice"), ">", 200000.0)], [(Ref("o_orderpriority"), "!=", "5-LOW")], [(Ref("o_totalprice"), ">=", 1000.0)]]
    return rel.file_scan(read(spark, sf_dir, "orders"), clauses, ["o_orderkey", "o_totalprice"])


@query("SELECT c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def rel_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = rel.file_scan(read(spark, sf_dir, "orders"), [[(Ref("o_orderpriority"), "=", "1-URGENT")]], ["o_orderkey", "o_custkey"])
    return rel.theta_join(read(spark, sf_dir, "customer"), orders, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_orderkey")


@query("SELECT c_name, p_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 1")
def rel_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = rel.file_scan(read(spark, sf_dir, "part"), [[(Ref("p_size"), "=", 1)]], ["p_partkey", "p_name"])
    lines = rel.theta_join(read(spark, sf_dir, "lineitem"), part, F.col("l_partkey") == F.col("p_partkey"))
    orders = rel.theta_join(read(spark, sf_dir, "orders"), lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return rel.sort(rel.theta_join(read(spark, sf_dir, "customer"), orders, F.col("c_custkey") == F.col("o_custkey")).select("c_name", "p_name"), "c_name", "p_name")


@query("SELECT c_name FROM customer JOIN orders ON c_custkey = o_custkey")
def rel_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.theta_join(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_name")


@query("SELECT DISTINCT c_name FROM customer JOIN orders ON c_custkey = o_custkey")
def rel_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.distinct(rel_q3(spark, sf_dir))


@query("SELECT c_name, c_acctbal, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 9000 OR o_totalprice < 2000")
def rel_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = rel.theta_join(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return rel.file_scan(joined, [[(Ref("c_acctbal"), ">", 9000.0), (Ref("o_totalprice"), "<", 2000.0)]], ["c_name", "c_acctbal", "o_totalprice"])


@query("SELECT s_name FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey WHERE s_acctbal > 5000 AND o_orderstatus = 'P' AND l_quantity > 45")
def rel_q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = rel.file_scan(read(spark, sf_dir, "supplier"), [[(Ref("s_acctbal"), ">", 5000.0)]], ["s_suppkey", "s_name"])
    lines = rel.file_scan(read(spark, sf_dir, "lineitem"), [[(Ref("l_quantity"), ">", 45.0)]], ["l_suppkey", "l_orderkey"])
    orders = rel.file_scan(read(spark, sf_dir, "orders"), [[(Ref("o_orderstatus"), "=", "P")]], ["o_orderkey"])
    joined = rel.theta_join(rel.theta_join(supplier, lines, F.col("s_suppkey") == F.col("l_suppkey")), orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rel.sort(joined.select("s_name"), "s_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey BETWEEN 100 AND 900")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.project(rel.key_range(read(spark, sf_dir, "part"), "p_partkey", 100, 900), "p_partkey", 2)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sort_ascending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sort(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT c_name, c_acctbal FROM customer")
def sort_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.sort(read(spark, sf_dir, "customer").select("c_name", "c_acctbal"), "c_acctbal", "c_name", descending=True)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def duplicate_elimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.distinct(read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.theta_join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def cartesian_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.theta_join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")).select("n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_extendedprice > o_totalprice")
def merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = rel.merge_join(read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), F.col("l_extendedprice") > F.col("o_totalprice"))
    return joined.select("o_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 2 <> 0 UNION ALL SELECT p_partkey + 1000000, p_size FROM part WHERE p_size = 1")
def record_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size")
    more = part.filter("p_size = 1").select((F.col("p_partkey") + 1_000_000).alias("p_partkey"), "p_size")
    return table.insert(table.delete(part, F.col("p_partkey") % 2 == 0), more)


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 0 ELSE p_size END AS p_size FROM part")
def record_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.update(read(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") > 40, {"p_size": F.lit(0)})


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def record_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.get(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), c_custkey=42)


@query("SELECT 'n_nationkey' AS attribute, count(*) AS tuples, CAST(min(n_nationkey) AS VARCHAR) AS least, CAST(max(n_nationkey) AS VARCHAR) AS greatest FROM nation UNION ALL SELECT 'n_name', count(*), min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR) FROM nation")
def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.statistics(read(spark, sf_dir, "nation")).drop("distinct")


@query(" UNION ALL ".join(f"SELECT '{c}' AS attribute, count(*) AS tuples, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in 'o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority'.split()))
def statistics_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and exact numbers of distinct values of a large table."""
    return catalog.statistics(read(spark, sf_dir, "orders")).select("attribute", "tuples", "distinct")


@query()
def shred_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole node table of all pages: elements, attributes, values and texts with their labels and parents."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return shred(pages, "html", None).select("doc_id", "start", "end", "level", "tag", "kind", "parent_start")


@query()
def shred_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all pages, by tag of their elements and level. SQL has no parser for them."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return shred(pages, "html", None).filter("kind = 'element'").groupBy("tag", "level").agg(F.count("*").alias("n"))
