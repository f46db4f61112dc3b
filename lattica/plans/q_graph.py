"""Queries of the property graph (families G, J, W and graph parts of A, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.common import table
from lattica.functions import text as T
from lattica.operators import graph as G
from lattica.plans.base import Book

BOOK = Book()
QUERIES, SQL = BOOK.queries, BOOK.sql


def _key(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), '\\s+', ' ', 'g'), '^ +| +$', '', 'g')"


def _rel(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({x}, '^ +| +$', '', 'g')), '[^A-Z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"


def _name(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({_key(x)}, '^(the|a|an) ', ''), '[^a-z0-9]+', ' ', 'g'))"


NODES = f"""nodes AS (SELECT node_id, min(name) AS name, min(label) AS label, count(*) AS mentions FROM (
  SELECT {_key('name')} AS node_id, name, coalesce(labels[1], '~') AS label FROM (SELECT subject AS name, subject_labels AS labels FROM triples UNION ALL SELECT object, object_labels FROM triples) WHERE name IS NOT NULL) WHERE node_id <> '' GROUP BY node_id)"""
EDGES = f"""edges AS (SELECT src, type, dst, min(triple_id) AS edge_id, count(*) AS n FROM (
  SELECT triple_id, {_key('subject')} AS src, {_rel('predicate')} AS type, {_key('object')} AS dst FROM triples WHERE subject IS NOT NULL AND object IS NOT NULL AND predicate IS NOT NULL) GROUP BY src, type, dst)"""
INC = "inc AS (SELECT src AS node, dst AS other, edge_id, type FROM edges UNION ALL SELECT dst, src, edge_id, type FROM edges WHERE src <> dst)"
DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node)"
SEEDS = f"seeds AS (SELECT DISTINCT {_key('subject')} AS node_id FROM triples WHERE triple_id % 100 = 0 AND subject IS NOT NULL)"


def _nodes(spark, d):
    return G.node_table(table(spark, d, "triples"))


def _edges(spark, d):
    return G.edge_table(table(spark, d, "triples"))


def _seeds(spark, d):
    """The stated query set: subjects of the triples whose id is divisible by 100, asked against the whole graph."""
    t = table(spark, d, "triples").filter("triple_id % 100 = 0 AND subject IS NOT NULL")
    return t.select(T.triple_key(F.col("subject")).alias("node_id")).distinct()


@BOOK.add("K02_graph_upsert_nodes", f"WITH {NODES} SELECT * FROM nodes")
def k02n(spark, d) -> DataFrame:
    return _nodes(spark, d)


@BOOK.add("K02_graph_upsert_edges", f"WITH {EDGES} SELECT * FROM edges")
def k02e(spark, d) -> DataFrame:
    return _edges(spark, d)


@BOOK.add("G01_nodes_by_text", f"WITH {NODES} SELECT node_id, name, label FROM nodes WHERE contains(node_id, 'olive') AND label IN ('Material', 'Product')")
def g01(spark, d) -> DataFrame:
    return _nodes(spark, d).filter(F.col("node_id").contains("olive") & F.col("label").isin("Material", "Product")).select("node_id", "name", "label")


@BOOK.add("G02_triples_by_text", f"WITH {EDGES} SELECT edge_id, src, type, dst FROM edges WHERE (contains(src, 'olive') OR contains(dst, 'olive')) AND type IN ('PRODUCES', 'DERIVED_FROM')")
def g02(spark, d) -> DataFrame:
    e = _edges(spark, d)
    return e.filter((F.col("src").contains("olive") | F.col("dst").contains("olive")) & F.col("type").isin("PRODUCES", "DERIVED_FROM")).select("edge_id", "src", "type", "dst")


@BOOK.add("G03_neighbors", f"WITH {EDGES}, {INC}, {SEEDS} SELECT node AS seed, other AS neighbour, count(*) AS n_edges FROM inc JOIN seeds ON node = node_id GROUP BY node, other")
def g03(spark, d) -> DataFrame:
    return G.neighbors(_edges(spark, d), _seeds(spark, d))


@BOOK.add("G04_subgraph_2hop", f"""WITH {EDGES}, {INC}, {SEEDS}, d0 AS (SELECT node_id AS seed, node_id AS node FROM seeds UNION SELECT s.node_id, i.other FROM seeds s JOIN inc i ON s.node_id = i.node)
SELECT DISTINCT seed, edge_id FROM d0 JOIN inc ON d0.node = inc.node""")
def g04(spark, d) -> DataFrame:
    return G.subgraph(_edges(spark, d), _seeds(spark, d), 2)


@BOOK.add("G05_adaptive_subgraph", f"""WITH {EDGES}, {INC}, {SEEDS}, h1 AS (SELECT DISTINCT node_id AS seed, edge_id FROM seeds JOIN inc ON node_id = node),
d0 AS (SELECT node_id AS seed, node_id AS node FROM seeds UNION SELECT s.node_id, i.other FROM seeds s JOIN inc i ON s.node_id = i.node), h2 AS (SELECT DISTINCT seed, edge_id FROM d0 JOIN inc ON d0.node = inc.node),
c AS (SELECT seed, count(*) AS n1 FROM h1 GROUP BY seed)
SELECT h2.seed, CASE WHEN any_value(n1) >= 5 THEN 1 ELSE 2 END AS hops, CASE WHEN any_value(n1) >= 5 THEN any_value(n1) ELSE count(*) END AS n_edges FROM h2 JOIN c ON h2.seed = c.seed GROUP BY h2.seed""")
def g05(spark, d) -> DataFrame:
    e, s = _edges(spark, d), _seeds(spark, d)
    one = G.subgraph(e, s, 1).groupBy("seed").agg(F.count(F.lit(1)).alias("n1"))
    two = G.subgraph(e, s, 2).groupBy("seed").agg(F.count(F.lit(1)).alias("n2"))
    enough = F.col("n1") >= 5
    return two.join(one, "seed").select("seed", F.when(enough, 1).otherwise(2).alias("hops"), F.when(enough, F.col("n1")).otherwise(F.col("n2")).alias("n_edges"))


PAIRS = "pairs AS (SELECT DISTINCT {s} AS a, {o} AS b FROM triples WHERE triple_id % 100 = 0 AND subject IS NOT NULL AND object IS NOT NULL)".format(s=_key("subject"), o=_key("object"))


def _pairs(spark, d):
    t = table(spark, d, "triples").filter("triple_id % 100 = 0 AND subject IS NOT NULL AND object IS NOT NULL")
    return t.select(T.triple_key(F.col("subject")).alias("a"), T.triple_key(F.col("object")).alias("b")).distinct()


@BOOK.add("G06_shortest_path_lengths", f"""WITH RECURSIVE {EDGES}, {INC}, {PAIRS}, w(seed, node, dist) AS (SELECT DISTINCT a, a, 0 FROM pairs UNION SELECT w.seed, inc.other, w.dist + 1 FROM w JOIN inc ON w.node = inc.node WHERE w.dist < 3)
SELECT a, b, min(dist) AS length FROM pairs JOIN w ON a = seed AND b = node GROUP BY a, b""")
def g06(spark, d) -> DataFrame:
    return G.shortest_lengths(_edges(spark, d), _pairs(spark, d), 3)


def closure_sql(arcs: str) -> str:
    """SQL of (u, c): the smallest vertex of the component of each vertex, by labels that spread over `arcs` (u, v both ways)."""
    return f"""WITH RECURSIVE arcs AS ({arcs}), cc(u, c) USING KEY (u) AS (SELECT DISTINCT u, u FROM arcs UNION
SELECT a.u, min(cc.c) FROM cc JOIN arcs a ON a.v = cc.u JOIN recurring.cc k ON k.u = a.u WHERE cc.c < k.c GROUP BY a.u)"""


ARCS = f"WITH {EDGES} SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges"


@BOOK.add("G07_components", closure_sql(ARCS) + " SELECT u AS node, c AS component FROM cc")
def g07(spark, d) -> DataFrame:
    return G.components(_edges(spark, d))


@BOOK.add("G08_contracted_edges", f"""WITH {EDGES}, m AS (SELECT src, type, dst FROM edges)
SELECT src, type, dst, min(edge_id) AS edge_id, sum(n)::BIGINT AS n FROM (SELECT regexp_replace(src, '^the ', '') AS src, type, regexp_replace(dst, '^the ', '') AS dst, edge_id, n FROM edges) WHERE src <> dst GROUP BY src, type, dst""")
def g08(spark, d) -> DataFrame:
    n = _nodes(spark, d).filter(F.col("node_id").startswith("the ")).select(F.col("node_id").alias("node"), F.regexp_replace("node_id", "^the ", "").alias("keep"))
    return G.contract(_edges(spark, d), n)


@BOOK.add("G11_duplicate_groups", f"""WITH {NODES}, {EDGES}, {DEG}, k AS (SELECT n.*, {_name('name')} AS key, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON n.node_id = deg.node)
SELECT key, node_id, label, degree, row_number() OVER (PARTITION BY key ORDER BY degree DESC, node_id)::INT AS rank FROM k WHERE key <> '' AND key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)""")
def g11(spark, d) -> DataFrame:
    return G.duplicate_groups(_nodes(spark, d), G.degrees(_edges(spark, d)))


@BOOK.add("G13_bridged_duplicates", f"""WITH {NODES}, {EDGES}, {DEG}, k AS (SELECT n.*, {_name('name')} AS key, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON n.node_id = deg.node),
g AS (SELECT key, node_id, row_number() OVER (PARTITION BY key ORDER BY degree DESC, node_id) AS rank FROM k WHERE key <> '' AND key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1)),
p AS (SELECT g.key, a.node_id AS anchor, g.node_id AS other, g.rank FROM g JOIN g a ON g.key = a.key AND a.rank = 1 WHERE g.rank > 1),
o AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = anchor AND e.dst = other) OR (e.src = other AND e.dst = anchor)))
SELECT key, anchor, other FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank) AS r FROM o) WHERE r <= 3""")
def g13(spark, d) -> DataFrame:
    e = _edges(spark, d)
    return G.bridged_duplicates(G.duplicate_groups(_nodes(spark, d), G.degrees(e)), e)


@BOOK.add("G12_merged_duplicates", f"""WITH {NODES}, {EDGES}, {DEG}, k AS (SELECT n.*, {_name('name')} AS key, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON n.node_id = deg.node WHERE name IS NOT NULL),
g AS (SELECT key, label, node_id, row_number() OVER (PARTITION BY key ORDER BY degree DESC, node_id) AS rank FROM k WHERE key <> '' AND key IN (SELECT key FROM k GROUP BY key HAVING count(*) > 1))
SELECT g.node_id AS node, a.node_id AS keep FROM g JOIN g a ON g.key = a.key AND a.rank = 1 WHERE g.rank > 1 AND g.label = a.label""")
def g12(spark, d) -> DataFrame:
    g = G.duplicate_groups(_nodes(spark, d), G.degrees(_edges(spark, d)))
    a = g.filter("rank = 1").select("key", F.col("node_id").alias("keep"), "label")
    return g.filter("rank > 1").select("key", F.col("node_id").alias("node"), "label").join(a, ["key", "label"]).select("node", "keep")


@BOOK.add("G14_isolated_registry_entries", f"SELECT DISTINCT entity_id FROM registry WHERE {_key('canonical_name')} NOT IN (SELECT {_key('subject')} FROM triples WHERE subject IS NOT NULL) AND {_key('canonical_name')} NOT IN (SELECT {_key('object')} FROM triples WHERE object IS NOT NULL)")
def g14(spark, d) -> DataFrame:
    t = table(spark, d, "triples")
    ends = t.select(T.triple_key(F.col("subject")).alias("k")).unionByName(t.select(T.triple_key(F.col("object")).alias("k"))).filter("k IS NOT NULL").distinct()
    r = table(spark, d, "registry").select("entity_id", T.triple_key(F.col("canonical_name")).alias("k")).filter("k IS NOT NULL")
    return r.join(ends, "k", "left_anti").select("entity_id").distinct()


# Renamings of edge types, with a mark where the ends are swapped.
RULES = [
    ("OWNED_BY_FIRM", "OWNS", True),
    ("FUNDED_THROUGH", "FUNDS", True),
    ("DERIVED_FROM", "YIELDS", True),
    ("FEEDS_INTO", "SUPPLIES", False),
    ("LOWERS", "REDUCES", False),
    ("RAISES", "INCREASES", False),
    ("MAKES", "PRODUCES", False),
    ("WRAPPED_IN", "PACKAGED_IN", False),
]
RULES_SQL = "rules(type, new, reverse) AS (VALUES " + ", ".join(f"('{a}', '{b}', {str(r).lower()})" for a, b, r in RULES) + ")"


@BOOK.add("G18_rewritten_types", f"""WITH {EDGES}, {RULES_SQL}
SELECT src, type, dst, min(edge_id) AS edge_id, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN coalesce(reverse, false) THEN dst ELSE src END AS src, coalesce(new, e.type) AS type, CASE WHEN coalesce(reverse, false) THEN src ELSE dst END AS dst, edge_id, n
FROM edges e LEFT JOIN rules r ON e.type = r.type) GROUP BY src, type, dst""")
def g18(spark, d) -> DataFrame:
    return G.rewrite_types(_edges(spark, d), RULES)


@BOOK.add("G16_inverted_edges", f"WITH {EDGES} SELECT dst AS src, 'FUNDS' AS type, src AS dst, min(edge_id) AS edge_id, sum(n)::BIGINT AS n FROM edges WHERE type = 'FUNDED_THROUGH' GROUP BY src, dst")
def g16(spark, d) -> DataFrame:
    return G.rewrite_types(_edges(spark, d).filter("type = 'FUNDED_THROUGH'"), [("FUNDED_THROUGH", "FUNDS", True)])


CANON = ["PRODUCES", "DERIVED_FROM", "FEEDS_INTO", "PROCESSED_WITH", "LOCATED_IN", "FUNDED_THROUGH", "MEASURED_AS", "STORED_AT", "PACKAGED_IN", "PARTNER_OF", "COMPLIES_WITH", "DELIVERS_TO"]
CANON_SQL = "c(canon) AS (VALUES " + ", ".join(f"('{x}')" for x in CANON) + ")"


@BOOK.add("G19_compacted_types", f"""WITH {EDGES}, {CANON_SQL}, t AS (SELECT type, string_split(type, '_') AS tw FROM edges GROUP BY type HAVING sum(n) <= 5 AND type NOT IN (SELECT canon FROM c)),
s AS (SELECT type, canon, round(len(list_intersect(tw, string_split(canon, '_'))) / len(list_distinct(list_concat(tw, string_split(canon, '_')))), 9) AS s FROM t CROSS JOIN c),
b AS (SELECT type, canon, s, row_number() OVER (PARTITION BY type ORDER BY s DESC, canon) AS r FROM s)
SELECT type, CASE WHEN s >= 0.3 THEN canon ELSE 'RELATED_TO' END AS new FROM b WHERE r = 1""")
def g19(spark, d) -> DataFrame:
    return G.compacted_types(_edges(spark, d), CANON)


@BOOK.add("G20_pattern_reclass", f"""WITH {NODES}, {EDGES} SELECT e.edge_id, CASE WHEN s.label = 'Organization' AND o.label = 'Place' THEN 'LOCATED_IN' WHEN s.label = 'Organization' AND o.label = 'Product' THEN 'PRODUCES' WHEN s.label = 'Product' AND o.label = 'Material' THEN 'DERIVED_FROM' ELSE e.type END AS type
FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes o ON e.dst = o.node_id""")
def g20(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    e = _edges(spark, d).join(n.select(F.col("node_id").alias("src"), F.col("label").alias("ls")), "src").join(n.select(F.col("node_id").alias("dst"), F.col("label").alias("lo")), "dst")
    new = F.when((F.col("ls") == "Organization") & (F.col("lo") == "Place"), "LOCATED_IN").when((F.col("ls") == "Organization") & (F.col("lo") == "Product"), "PRODUCES").when((F.col("ls") == "Product") & (F.col("lo") == "Material"), "DERIVED_FROM")
    return e.select("edge_id", F.coalesce(new, F.col("type")).alias("type"))


@BOOK.add("G21_relation_to_property", f"WITH {EDGES} SELECT DISTINCT src AS node, dst AS published FROM edges WHERE type = 'PUBLISHED_DURING'")
def g21(spark, d) -> DataFrame:
    """One row for each value of the property, so a hub is never one row."""
    return _edges(spark, d).filter("type = 'PUBLISHED_DURING'").select(F.col("src").alias("node"), F.col("dst").alias("published")).distinct()


@BOOK.add("G25_self_loops", f"WITH {EDGES} SELECT edge_id, src, type FROM edges WHERE src = dst")
def g25(spark, d) -> DataFrame:
    return _edges(spark, d).filter("src = dst").select("edge_id", "src", "type")


@BOOK.add("G26_existing_types", f"WITH {EDGES}, {INC}, {SEEDS} SELECT node_id, count(DISTINCT type) AS n_types, count(node) > 0 AS known FROM seeds LEFT JOIN inc ON node_id = node GROUP BY node_id")
def g26(spark, d) -> DataFrame:
    inc = G.incident(_edges(spark, d)).withColumnRenamed("node", "node_id")
    return _seeds(spark, d).join(inc, "node_id", "left").groupBy("node_id").agg(F.countDistinct("type").alias("n_types"), (F.count("edge_id") > 0).alias("known"))


@BOOK.add("G27_bridge_edges", f"""WITH {EDGES}, {INC}, {PAIRS}, two AS (SELECT a, b, i.edge_id AS e1, j.edge_id AS e2 FROM pairs JOIN inc i ON a = i.node JOIN inc j ON b = j.node AND i.other = j.other WHERE i.other <> a AND i.other <> b)
SELECT DISTINCT a, b, edge_id FROM pairs JOIN inc ON a = node AND b = other UNION SELECT a, b, e1 FROM two UNION SELECT a, b, e2 FROM two""")
def g27(spark, d) -> DataFrame:
    return G.bridges(_edges(spark, d), _pairs(spark, d))


@BOOK.add("G28_off_vocabulary_types", f"WITH {EDGES} SELECT type, count(*) AS n FROM edges WHERE type NOT IN (SELECT predicate FROM relation_vocab) GROUP BY type")
def g28(spark, d) -> DataFrame:
    v = table(spark, d, "relation_vocab").select(F.col("predicate").alias("type"))
    return _edges(spark, d).join(v, "type", "left_anti").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("G29_resolvable_registry", f"WITH {NODES}, r AS (SELECT DISTINCT entity_id, {_key('canonical_name')} AS k FROM registry) SELECT count(*) AS n, count(node_id) AS resolved FROM r LEFT JOIN nodes ON k = node_id")
def g29(spark, d) -> DataFrame:
    r = table(spark, d, "registry").select("entity_id", T.triple_key(F.col("canonical_name")).alias("node_id")).distinct()
    n = _nodes(spark, d).select("node_id", F.lit(1).alias("hit"))
    return r.join(n, "node_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("resolved"))


@BOOK.add("G30_same_as_links", "SELECT DISTINCT entity_id, alias, canonical_name FROM (SELECT entity_id, canonical_name, unnest(aliases) AS alias, alias_sources FROM registry) WHERE alias <> canonical_name")
def g30(spark, d) -> DataFrame:
    r = table(spark, d, "registry").select("entity_id", "canonical_name", F.explode("aliases").alias("alias"))
    return r.filter("alias <> canonical_name").select("entity_id", "alias", "canonical_name").distinct()


@BOOK.add("G30_mentioned_in", f"SELECT DISTINCT {_key('subject')} AS entity, relationship_properties['source_doc'] AS document, relationship_properties['chunk_id'] AS chunk_id FROM triples WHERE subject IS NOT NULL")
def g30b(spark, d) -> DataFrame:
    p = F.col("relationship_properties")
    return table(spark, d, "triples").filter("subject IS NOT NULL").select(T.triple_key(F.col("subject")).alias("entity"), p["source_doc"].alias("document"), p["chunk_id"].alias("chunk_id")).distinct()


# ---- A: graph aggregates


@BOOK.add("A01_nodes_by_label", f"SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM (SELECT DISTINCT entity_id, labels FROM registry)) GROUP BY label")
def a01(spark, d) -> DataFrame:
    return table(spark, d, "registry").select("entity_id", "labels").distinct().select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("A01_edges_by_type", f"WITH {EDGES} SELECT type, count(*) AS n_edges, sum(n)::BIGINT AS n_triples FROM edges GROUP BY type")
def a01b(spark, d) -> DataFrame:
    return _edges(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("n").alias("n_triples"))


@BOOK.add("A02_duplicate_names", f"SELECT name, n, labels FROM (SELECT {_name('canonical_name')} AS name, count(DISTINCT entity_id) AS n, array_to_string(list_sort(list_distinct(flatten(list(labels)))), '|') AS labels FROM registry GROUP BY 1) WHERE n > 1 AND name IS NOT NULL")
def a02(spark, d) -> DataFrame:
    r = table(spark, d, "registry").withColumn("name", T.name_key(F.col("canonical_name"))).filter("name IS NOT NULL")
    g = r.groupBy("name").agg(F.countDistinct("entity_id").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))), "|").alias("labels"))
    return g.filter("n > 1")


@BOOK.add("A03_token_document_frequency", f"WITH {NODES} SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(node_id, '[\\p{{L}}\\p{{N}}_]+'))) AS token FROM nodes) GROUP BY token".replace("\\\\", "\\"))
def a03(spark, d) -> DataFrame:
    return _nodes(spark, d).select(F.explode(F.array_distinct(T.words(F.col("node_id")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


@BOOK.add("A04_type_patterns", f"""WITH p AS (SELECT {_rel('predicate')} AS type, coalesce(subject_labels[1], '') || '>' || coalesce(object_labels[1], '') AS pattern, count(*) AS n FROM triples WHERE predicate IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, pattern) AS k, sum(n) OVER (PARTITION BY type)::BIGINT AS total FROM p) SELECT type, pattern, n, total FROM r WHERE k <= 3""")
def a04(spark, d) -> DataFrame:
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    t = table(spark, d, "triples").filter("predicate IS NOT NULL").groupBy(T.relation_type(F.col("predicate")).alias("type"), F.concat_ws(">", first("subject_labels"), first("object_labels")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("type")
    return t.withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "pattern"))).withColumn("total", F.sum("n").over(w)).filter("k <= 3").select("type", "pattern", "n", "total")


@BOOK.add("A05_mention_counts", f"SELECT triple_id, coalesce(relationship_properties['mention_count'], (count(*) OVER (PARTITION BY {_key('subject')}, {_key('predicate')}, {_key('object')}))::VARCHAR) AS mention_count FROM triples")
def a05(spark, d) -> DataFrame:
    w = Window.partitionBy(T.triple_key(F.col("subject")), T.triple_key(F.col("predicate")), T.triple_key(F.col("object")))
    return table(spark, d, "triples").withColumn("c", F.count(F.lit(1)).over(w)).select("triple_id", F.coalesce(F.col("relationship_properties")["mention_count"], F.col("c").cast("string")).alias("mention_count"))


@BOOK.add("A06_predicate_tally", "SELECT predicate, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM triples GROUP BY predicate")
def a06(spark, d) -> DataFrame:
    return table(spark, d, "triples").groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects"))


@BOOK.add("A20_graph_quality", f"""WITH {EDGES}, {DEG}, p AS (SELECT type, count(*) AS n FROM edges GROUP BY type), t AS (SELECT sum(n) AS s FROM p)
SELECT (SELECT count(*) FROM edges) AS n_edges, count(*) AS n_nodes, round(avg(degree), 6) AS avg_degree, round(median(degree), 6) AS median_degree, round(avg((degree <= 1)::INT), 6) AS share_low,
  (SELECT round(-sum(n / s * log2(n / s)), 6) FROM p, t) AS type_entropy FROM deg""")
def a20(spark, d) -> DataFrame:
    e = _edges(spark, d)
    deg = G.degrees(e).agg(F.count(F.lit(1)).alias("n_nodes"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.round(F.percentile("degree", 0.5), 6).alias("median_degree"), F.round(F.avg((F.col("degree") <= 1).cast("int")), 6).alias("share_low"))
    p = e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    tot = p.agg(F.sum("n").alias("n_edges"), F.sum(F.col("n") * F.log2("n")).alias("h"))
    ent = tot.select("n_edges", F.round(F.log2("n_edges") - F.col("h") / F.col("n_edges"), 6).alias("type_entropy"))
    return deg.join(F.broadcast(ent))


@BOOK.add("A22_simple_graph_degrees", f"WITH {EDGES}, u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM u UNION ALL SELECT b FROM u) GROUP BY node")
def a22(spark, d) -> DataFrame:
    u = _edges(spark, d).filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return G.degrees(u)


@BOOK.add("A23_document_properties", f"SELECT {_key('subject')} AS entity, count(DISTINCT relationship_properties['source_doc']) AS n_documents, count(*) AS n_mentions FROM triples WHERE subject IS NOT NULL GROUP BY 1")
def a23(spark, d) -> DataFrame:
    return table(spark, d, "triples").filter("subject IS NOT NULL").groupBy(T.triple_key(F.col("subject")).alias("entity")).agg(F.countDistinct(F.col("relationship_properties")["source_doc"]).alias("n_documents"), F.count(F.lit(1)).alias("n_mentions"))


@BOOK.add("A24_alias_registry", f"SELECT {_name('a')} AS key, string_agg(a, '|' ORDER BY a) AS aliases, count(*) AS n FROM (SELECT DISTINCT unnest(aliases) AS a FROM registry) GROUP BY 1")
def a24(spark, d) -> DataFrame:
    a = table(spark, d, "registry").select(F.explode("aliases").alias("a")).distinct()
    return a.groupBy(T.name_key(F.col("a")).alias("key")).agg(F.array_join(F.array_sort(F.collect_list("a")), "|").alias("aliases"), F.count(F.lit(1)).alias("n"))


# ---- J, W over the graph


@BOOK.add("J06_full_pattern", f"WITH {NODES}, {EDGES} SELECT e.edge_id, s.name AS subject, e.type, o.name AS object FROM edges e JOIN nodes s ON e.src = s.node_id JOIN nodes o ON e.dst = o.node_id")
def j06(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    e = _edges(spark, d).join(n.select(F.col("node_id").alias("src"), F.col("name").alias("subject")), "src")
    return e.join(n.select(F.col("node_id").alias("dst"), F.col("name").alias("object")), "dst").select("edge_id", "subject", "type", "object")


@BOOK.add("J07_incident_edges", f"WITH {EDGES}, {INC}, {SEEDS} SELECT edge_id, count(DISTINCT node) AS n_seeds FROM inc JOIN seeds ON node = node_id GROUP BY edge_id")
def j07(spark, d) -> DataFrame:
    return G.incident(_edges(spark, d)).join(_seeds(spark, d).withColumnRenamed("node_id", "node"), "node", "left_semi").groupBy("edge_id").agg(F.countDistinct("node").alias("n_seeds"))


@BOOK.add("J16_alias_rewrite", f"""WITH m AS (SELECT {_key('a')} AS k, min(entity_id) AS entity_id FROM (SELECT entity_id, unnest(aliases) AS a FROM registry) GROUP BY 1)
SELECT triple_id, s.entity_id AS subject_id, o.entity_id AS object_id FROM triples t LEFT JOIN m s ON {_key('t.subject')} = s.k LEFT JOIN m o ON {_key('t.object')} = o.k""")
def j16(spark, d) -> DataFrame:
    m = table(spark, d, "registry").select("entity_id", F.explode("aliases").alias("a")).groupBy(T.triple_key(F.col("a")).alias("k")).agg(F.min("entity_id").alias("id"))
    t = table(spark, d, "triples").select("triple_id", T.triple_key(F.col("subject")).alias("s"), T.triple_key(F.col("object")).alias("o"))
    t = t.join(m.select(F.col("k").alias("s"), F.col("id").alias("subject_id")), "s", "left")
    return t.join(m.select(F.col("k").alias("o"), F.col("id").alias("object_id")), "o", "left").select("triple_id", "subject_id", "object_id")


@BOOK.add("J19_edge_context", f"""WITH {EDGES}, {INC}, ends AS (SELECT edge_id, src AS node FROM edges UNION SELECT edge_id, dst FROM edges),
r AS (SELECT a.edge_id, a.node, b.edge_id AS other, row_number() OVER (PARTITION BY a.edge_id, a.node ORDER BY b.edge_id) AS k FROM ends a JOIN inc b ON a.node = b.node AND a.edge_id <> b.edge_id)
SELECT edge_id, node, other FROM r WHERE k <= 3""")
def j19(spark, d) -> DataFrame:
    """The first three other edges of both endpoints of every edge."""
    inc = G.incident(_edges(spark, d)).select("node", "edge_id")
    # only the first four edges of a node can be among the first three others
    first = inc.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("edge_id"))).filter("k <= 4").select("node", F.col("edge_id").alias("other"))
    j = inc.join(first, "node").filter("edge_id <> other")
    return j.withColumn("k", F.row_number().over(Window.partitionBy("edge_id", "node").orderBy("other"))).filter("k <= 3").select("edge_id", "node", "other")


@BOOK.add("J20_degree_with_zero", f"WITH {NODES}, {EDGES}, o AS (SELECT src, count(*) AS c FROM edges GROUP BY src) SELECT node_id, coalesce(c, 0) AS out_degree FROM nodes LEFT JOIN o ON node_id = src")
def j20(spark, d) -> DataFrame:
    o = _edges(spark, d).groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("c"))
    return _nodes(spark, d).join(o, "node_id", "left").select("node_id", F.coalesce("c", F.lit(0)).alias("out_degree"))


@BOOK.add("W03_best_of_duplicates", f"SELECT entity_id, canonical_name FROM (SELECT entity_id, canonical_name, row_number() OVER (PARTITION BY {_name('canonical_name')} ORDER BY len(aliases) DESC, entity_id) AS r FROM (SELECT DISTINCT entity_id, canonical_name, aliases FROM registry) WHERE canonical_name IS NOT NULL) WHERE r = 1")
def w03(spark, d) -> DataFrame:
    r = table(spark, d, "registry").select("entity_id", "canonical_name", "aliases").distinct().filter("canonical_name IS NOT NULL")
    w = Window.partitionBy(T.name_key(F.col("canonical_name"))).orderBy(F.desc(F.size("aliases")), "entity_id")
    return r.withColumn("r", F.row_number().over(w)).filter("r = 1").select("entity_id", "canonical_name")


@BOOK.add("K17_name_constraints", "SELECT count(*) FILTER (WHERE canonical_name IS NULL) AS n_null, count(*) - count(DISTINCT canonical_name) AS n_repeated FROM (SELECT DISTINCT entity_id, canonical_name FROM registry)")
def k17(spark, d) -> DataFrame:
    r = table(spark, d, "registry").select("entity_id", "canonical_name").distinct()
    return r.agg(F.count_if(F.col("canonical_name").isNull()).alias("n_null"), (F.count(F.lit(1)) - F.countDistinct("canonical_name")).alias("n_repeated"))


@BOOK.add("K13_search_texts", "SELECT DISTINCT entity_id, canonical_name || chr(10) || array_to_string(aliases, chr(10)) AS search_text FROM registry WHERE canonical_name IS NOT NULL")
def k13(spark, d) -> DataFrame:
    return table(spark, d, "registry").filter("canonical_name IS NOT NULL").select("entity_id", F.concat_ws("\n", "canonical_name", F.array_join("aliases", "\n")).alias("search_text")).distinct()
