"""Citation-graph queries over all parts.

Part i cites parts 7i+1, 13i+5 and i*i+3, modulo the number of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import ROLE_LABELS
from ..operators import graph as G
from ..operators.textindex import build_tfidf, word_grams
from ..session import kept, scratch
from .identifiers import _PHRASES, _phrase
from .registry import query
from .tables import table

_TITLE = f"coalesce({_phrase(0)}, p_name)"
_TITLE_ROLE = "CASE {k} % " + str(len(_PHRASES)) + " " + " ".join(f"WHEN {n} THEN '{p[2] if p[1] == 'NULL' else {8: 'dimensions'}.get(n, 'related_product')}'" for n, p in enumerate(_PHRASES)) + " END"
_STATUS = "CASE p_partkey % 7 WHEN 0 THEN 'withdrawn' WHEN 1 THEN 'superseded' WHEN 2 THEN 'under_revision' ELSE 'current' END"

_EDGES = f"""n AS (SELECT count(*) AS n FROM part),
e AS (SELECT src, pos, dst, {_TITLE_ROLE.format(k="dst")} AS role FROM (
  SELECT p_partkey AS src, 0 AS pos, (7 * p_partkey + 1) % (SELECT n FROM n) AS dst FROM part UNION ALL
  SELECT p_partkey, 1, (13 * p_partkey + 5) % (SELECT n FROM n) FROM part UNION ALL
  SELECT p_partkey, 2, (p_partkey * p_partkey + 3) % (SELECT n FROM n) FROM part))"""
_BFS = f"""{_EDGES},
h1 AS (SELECT src AS root, dst AS node, pos, role, row_number() OVER (PARTITION BY src ORDER BY pos) AS visit FROM
  (SELECT * FROM e WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY pos) = 1)),
h2 AS (SELECT h1.root, e.dst AS node, h1.visit, e.pos, e.role FROM h1 JOIN e ON e.src = h1.node
  WHERE e.dst <> h1.root AND NOT EXISTS (SELECT 1 FROM h1 o WHERE o.root = h1.root AND o.node = e.dst)
  QUALIFY row_number() OVER (PARTITION BY h1.root, e.dst ORDER BY h1.visit, e.pos) = 1),
c AS (SELECT root, node, 1 AS hop, role, visit FROM h1 UNION ALL
  SELECT root, node, 2, role, row_number() OVER (PARTITION BY root ORDER BY visit, pos) FROM h2)"""
_LABELS = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_LABELS.items()) + " END"


def standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    n = parts.agg(F.count("*").alias("n"))
    cited = [(F.col("p_partkey") * a + b) % F.col("n") for a, b in ((7, 1), (13, 5), (F.col("p_partkey"), 3))]
    return parts.crossJoin(F.broadcast(n)).select(
        F.col("p_partkey").alias("is_number"), F.expr(_TITLE).alias("title"), F.array(*cited).alias("normative_references"), F.expr(_STATUS).alias("status"), F.col("p_name")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.build_edges(standards(spark, sf_dir))


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"))


@query("edge_build", f"WITH {_EDGES} SELECT src, pos, dst, role FROM e")
def edge_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).select("src", "pos", "dst", "role")


@query("bfs_closure", f"WITH {_BFS} SELECT root, node, hop, role, visit FROM c")
def bfs_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs_closure(edges(spark, sf_dir), roots(spark, sf_dir))


@query(
    "closure_first_type",
    f"""WITH {_EDGES}, p AS (SELECT DISTINCT src AS root, dst AS node, role AS first_type, 1 AS hop FROM e UNION ALL
    SELECT DISTINCT a.src, b.dst, a.role, 2 FROM e a JOIN e b ON b.src = a.dst),
    m AS (SELECT root, node, first_type, min(hop) AS hop FROM p WHERE node <> root GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY root ORDER BY hop, node, first_type) AS place FROM m QUALIFY place <= 40""",
)
def closure_first_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_type_closure(edges(spark, sf_dir), roots(spark, sf_dir))


_CHAIN = """e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst, 'halved' AS role FROM part UNION ALL SELECT p_partkey, p_partkey // 3, 'third' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 0, max(p_partkey) // 4, 'back' FROM part)"""


@query(
    "closure_full",
    f"""WITH RECURSIVE {_CHAIN}, r AS (SELECT src AS root, role AS first_type, dst AS node, 1 AS hop FROM e WHERE dst <> src UNION SELECT r.root, r.first_type, e.dst, hop + 1 FROM r JOIN e ON e.src = r.node WHERE e.dst <> r.root AND hop < 64)
    SELECT root, first_type, node, min(hop)::INT AS hop FROM r WHERE root IN (SELECT p_partkey FROM part) GROUP BY ALL""",
)
def closure_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that each part leads to, however far: part i names i / 2 and, if it divides, i / 3; 0 leads back into the middle."""
    links = spark.sql(f"WITH {_CHAIN.replace('//', 'DIV')} SELECT * FROM e".replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))
    return G.full_closure(links, roots(spark, sf_dir), kept)


_NODES = f"""{_EDGES}, n0 AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS hop FROM part),
n1 AS (SELECT DISTINCT src AS root, dst AS node, 1 AS hop FROM e WHERE src <> dst),
n2 AS (SELECT DISTINCT n1.root, e.dst AS node, 2 AS hop FROM n1 JOIN e ON e.src = n1.node WHERE NOT EXISTS (SELECT 1 FROM n1 o WHERE o.root = n1.root AND o.node = e.dst) AND e.dst <> n1.root)"""


@query("neighbourhood_nodes", f"WITH {_NODES} SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2")
def neighbourhood_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(edges(spark, sf_dir), roots(spark, sf_dir))[0]


@query("neighbourhood_edges", f"WITH {_NODES} SELECT root, src, dst, role FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1) JOIN e ON src = node")
def neighbourhood_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(edges(spark, sf_dir), roots(spark, sf_dir))[1]


_SIMILAR = f"""{_BFS},
w0 AS (SELECT p_partkey AS doc_id, regexp_extract_all(lower(p_name), '[a-z]{{2,}}') AS ws FROM part),
w1 AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w0) GROUP BY ALL),
w2 AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM w1 GROUP BY term),
w3 AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS r FROM w1 JOIN w2 USING (term)),
w AS (SELECT doc_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id)) AS w FROM w3),
s AS (SELECT root, node, sum(a.w * b.w) AS similarity FROM c JOIN w a ON a.doc_id = root JOIN w b ON b.doc_id = node AND b.term = a.term GROUP BY ALL),
r AS (SELECT c.*, round(0.6 / hop + 0.4 * round(coalesce(similarity, 0), 6), 3) AS relevance FROM c LEFT JOIN s USING (root, node))"""


def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    closure = G.bfs_closure(edges(spark, sf_dir), roots(spark, sf_dir))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"))
    similar = G.pair_similarity(closure, kept(build_tfidf(names, scratch(spark, "names"), word_grams).rows, "weights"), "root", "node")
    return similar.withColumn("relevance", G.relevance(F.col("hop"), F.round("similarity", 6)))


@query("allied_relevance", f"WITH {_SIMILAR} SELECT root, node, hop, role, relevance FROM r")
def allied_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relevant(spark, sf_dir).select("root", "node", "hop", "role", "relevance")


@query(
    "group_by_role",
    f"WITH {_SIMILAR} SELECT root, {_LABELS} AS role_label, string_agg(node::VARCHAR, ',' ORDER BY relevance DESC, hop, visit) AS members FROM r GROUP BY root, role",
)
def group_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.group_by_role(_relevant(spark, sf_dir)).select("root", "role_label", F.array_join("members", ",").alias("members"))


@query(
    "supersession",
    f"""WITH n AS (SELECT count(*) AS n FROM part), r AS (SELECT (p_partkey * 3 + 2) % (SELECT n FROM n) AS old, min(p_partkey) AS new FROM part WHERE p_partkey % 11 = 0 GROUP BY ALL)
    SELECT p_partkey AS is_number, CASE WHEN new IS NOT NULL THEN 'superseded' ELSE {_STATUS} END AS status, new AS superseded_by FROM part LEFT JOIN r ON old = p_partkey""",
)
def supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = standards(spark, sf_dir).withColumn("superseded_by", F.lit(None).cast("long"))
    n = rows.agg(F.count("*").alias("n"))
    replaced = rows.crossJoin(F.broadcast(n)).filter("is_number % 11 = 0").select(F.col("is_number").alias("new"), ((F.col("is_number") * 3 + 2) % F.col("n")).alias("old"))
    return G.supersede(rows, replaced).select("is_number", "status", "superseded_by")


@query(
    "graph_upsert",
    f"""WITH {_EDGES} SELECT src, dst, role FROM e WHERE src % 10 <> 0 UNION ALL
    SELECT p_partkey, (p_partkey + 1) % (SELECT n FROM n), 'related_product' FROM part WHERE p_partkey % 10 = 0""",
)
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth standard gets one new reference in place of its old ones."""
    old = edges(spark, sf_dir).select("src", "dst", "role")
    rows = standards(spark, sf_dir)
    n = rows.agg(F.count("*").alias("n"))
    fresh = rows.filter("is_number % 10 = 0").crossJoin(F.broadcast(n)).select(F.col("is_number").alias("src"), ((F.col("is_number") + 1) % F.col("n")).alias("dst"), F.lit("related_product").alias("role"))
    return G.replace_edges(old, fresh, fresh)


@query(
    "dot_graph",
    f"""WITH {_EDGES}, o AS (SELECT DISTINCT src AS root, dst AS node FROM e WHERE src <> dst UNION SELECT p_partkey, p_partkey FROM part),
    s AS (SELECT p_partkey, {_STATUS} AS status FROM part),
    a AS (SELECT root, string_agg('  "' || node || '" [style=filled, fillcolor=' || CASE WHEN status = 'current' THEN 'palegreen' WHEN status IN ('withdrawn', 'superseded') THEN 'lightcoral' ELSE 'lightgrey' END || '];', chr(10)
      ORDER BY '  "' || node || '" [style') AS t FROM o JOIN s ON p_partkey = node GROUP BY root),
    b AS (SELECT src AS root, string_agg(l, chr(10) ORDER BY l) AS t FROM (SELECT src, '  "' || src || '" -> "' || dst || '" [label="' || role || '"];' AS l FROM e) GROUP BY ALL)
    SELECT a.root, 'digraph {{' || chr(10) || a.t || chr(10) || b.t || chr(10) || '}}' AS dot FROM a JOIN b USING (root)""".replace("{{", "{").replace("}}", "}"),
)
def dot_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, links = G.neighbourhood(edges(spark, sf_dir), roots(spark, sf_dir), depth=1)
    status = standards(spark, sf_dir).select(F.col("is_number").alias("node"), "status")
    return G.dot_graph(nodes.join(status, "node"), links)
