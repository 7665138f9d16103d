"""Jobs of semantic memory, knowledge graphs, graph tables, policies, ids and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions.order import number, over
from ..operators import cron, graphs, memory, resilience
from ..sources.tables import EVENTS_SQL, FRAGMENTS_SQL, KEY, ORDER, events, fragments, read
from .registry import job

E = f"WITH {EVENTS_SQL}"
W = "(PARTITION BY user_id ORDER BY ms, event_id)"
FR = f"WITH {FRAGMENTS_SQL}"


@job("k1_cosine", """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(coalesce(list_cosine_similarity(x, y), 0), 6) AS score FROM p""")
def k1(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(memory.cosine(F.col("x"), F.col("y")), 6).alias("score"))


@job("k2_valid_at", f"{FR} SELECT idx, valid_from IS NULL AND valid_to IS NULL AS always, (valid_from IS NULL OR valid_from <= 120) AND (valid_to IS NULL OR valid_to > 120) AS then FROM fr")
def k2(spark, d):
    return fragments(spark, d).select("idx", memory.valid_at(None).alias("always"), memory.valid_at(120).alias("then"))


@job("k3_filter_fragments", f"""{FR} SELECT idx, id FROM fr WHERE (valid_from IS NULL OR valid_from <= 200) AND (valid_to IS NULL OR valid_to > 200) AND confidence >= 0.05
AND list_has_any(tags, ['de', 'src3']) ORDER BY confidence DESC, t_ns DESC, idx LIMIT 40""")
def k3(spark, d):
    return memory.filter_fragments(fragments(spark, d), 40, as_of=200, least=0.05, tags=["de", "src3"]).select("idx", "id")


@job("k4_fragment_errors", f"""{FR} SELECT idx, concat_ws('; ', CASE WHEN id = '' THEN 'id is empty' END, CASE WHEN confidence > 1 THEN 'confidence is not in [0, 1]' END,
CASE WHEN valid_from >= valid_to THEN 'validity is empty' END) AS errors FROM fr""")
def k4(spark, d):
    return memory.errors(fragments(spark, d)).select("idx", F.array_join("errors", "; ").alias("errors"))


@job("k5_admission", f"""{FR} SELECT idx, coalesce(confidence >= 0.1, false) AS scored, confidence >= 0.5 AND len(tags) / 10.0 >= 0.1 AND idx % 4 > 0 AS by_three FROM fr""")
def k5(spark, d):
    f = fragments(spark, d)
    scored = memory.admitted({"relevance": F.col("confidence")}, {"relevance": 0.1})
    three = memory.admitted_3d(F.col("confidence"), F.size("tags") / 10.0, (F.col("idx") % 4).cast("double"))
    return f.select("idx", scored.alias("scored"), three.alias("by_three"))


@job("k6_tenant_shard", "SELECT doc_id, CASE lang WHEN 'en' THEN '0' WHEN 'de' THEN '1' ELSE '2' END AS shard, source AS own FROM documents")
def k6(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", memory.tenant_shard(F.col("lang"), ["en", "de", "en"]).alias("shard"), memory.tenant_shard(F.col("source")).alias("own"))


@job("k7_first_valid", f"""{FR} SELECT idx, CASE WHEN NOT ok THEN 'invalid' WHEN row_number() OVER (PARTITION BY id, ok ORDER BY idx) > 1 THEN 'duplicate' ELSE 'kept' END AS state FROM frs""")
def k7_state(spark, d):
    return memory.first_valid(fragments(spark, d)).select("idx", "state")


@job("k7_retrieve", f"""{FR}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7)
SELECT idx, round(coalesce(list_cosine_similarity(embedding, v), 0), 6) AS score FROM frk, q WHERE valid_from IS NULL AND valid_to IS NULL
ORDER BY coalesce(list_cosine_similarity(embedding, v), 0) DESC, confidence DESC, t_ns DESC, idx LIMIT 25""")
def k7(spark, d):
    vector = read(spark, d, "embeddings").where("vec_id = 7").first()["embedding"]
    return memory.retrieve(fragments(spark, d), vector, 25).select("idx", F.round("score", 6).alias("score"))


@job("k7_retrieve_all", f"""{FR}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 10 = 0),
s AS (SELECT query_id, idx, coalesce(list_cosine_similarity(embedding, v), 0) AS score, confidence, t_ns FROM frk, q WHERE embedding IS NOT NULL)
SELECT query_id, idx, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, t_ns DESC, idx) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""")
def k7_all(spark, d):
    vectors = read(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    kept = memory.first_valid(fragments(spark, d)).where("state = 'kept'")
    return memory.retrieve_all(kept, vectors, 3).select("query_id", "idx", "rank")


def assertions(spark, d):
    """Orders, customers and nations as assertions; ids of customers repeat and one predicate is outside the policy."""
    o, c, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    say = lambda df, i, key, s, p, ob, lit: df.select(i.alias("idx"), key.alias("id"), s.alias("subject_id"), F.lit(p).alias("predicate"), ob.alias("object_entity_id"), lit.alias("object_literal"))
    no = F.lit(None).cast("string")
    name = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
    return (
        say(o, F.col("o_orderkey") * 3, name("po", "o_orderkey"), name("c", "o_custkey"), "placed", name("o", "o_orderkey"), no)
        .union(say(o, F.col("o_orderkey") * 3 + 1, name("st", "o_orderkey"), name("o", "o_orderkey"), "status", no, F.col("o_orderstatus")))
        .union(say(o, F.col("o_orderkey") * 3 + 2, F.concat(F.lit("in"), F.col("o_custkey").cast("string")), name("c", "o_custkey"), "wants", no, F.col("o_orderpriority")))
        .union(say(c.join(n, c["c_nationkey"] == n["n_nationkey"]), -F.col("c_custkey") - 1, name("na", "c_custkey"), name("c", "c_custkey"), "lives in", F.col("n_name"), no))
        .union(say(o, F.col("o_orderkey") * 3, name("xx", "o_orderkey"), name("o", "o_orderkey"), "secret", no, F.lit("x")))
    )


KG = """WITH a AS (SELECT o_orderkey * 3 AS idx, 'po' || o_orderkey AS id, 'c' || o_custkey AS subject_id, 'placed' AS predicate, 'o' || o_orderkey AS object_entity_id, NULL AS object_literal FROM orders
UNION ALL SELECT o_orderkey * 3 + 1, 'st' || o_orderkey, 'o' || o_orderkey, 'status', NULL, o_orderstatus FROM orders
UNION ALL SELECT o_orderkey * 3 + 2, 'in' || o_custkey, 'c' || o_custkey, 'wants', NULL, o_orderpriority FROM orders
UNION ALL SELECT -c_custkey - 1, 'na' || c_custkey, 'c' || c_custkey, 'lives in', n_name, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT o_orderkey * 3, 'xx' || o_orderkey, 'o' || o_orderkey, 'secret', NULL, 'x' FROM orders),
v AS (SELECT *, predicate IN ('placed', 'status', 'wants', 'lives in') AS ok FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY id, ok ORDER BY idx) AS rk FROM v), kept AS (SELECT * FROM r WHERE ok AND rk = 1)"""
POLICY = ["placed", "status", "wants", "lives in"]


@job("k8_kg_entities", f"""{KG}, x AS (SELECT subject_id AS entity, id, 'subject' AS role FROM kept UNION SELECT object_entity_id, id, 'object' FROM kept WHERE object_entity_id IS NOT NULL)
SELECT entity, coalesce(string_agg(CASE WHEN role = 'subject' THEN id END, ',' ORDER BY id), '') AS as_subject, coalesce(string_agg(CASE WHEN role = 'object' THEN id END, ',' ORDER BY id), '') AS as_object FROM x GROUP BY 1""")
def k8(spark, d):
    out = memory.knowledge_graph(assertions(spark, d), POLICY)["entities"]
    return out.select("entity", F.array_join("as_subject", ",").alias("as_subject"), F.array_join("as_object", ",").alias("as_object"))


@job("k8_kg_relations", f"{KG} SELECT id, subject_id, predicate, object_entity_id FROM kept WHERE object_entity_id IS NOT NULL")
def k8_relations(spark, d):
    return memory.knowledge_graph(assertions(spark, d), POLICY)["relations"]


@job("k8_kg_topics", f"""{KG}, n AS (SELECT predicate, subject_id AS e FROM kept UNION SELECT predicate, object_entity_id FROM kept WHERE object_entity_id IS NOT NULL)
SELECT k.predicate, assertions, entities FROM (SELECT predicate, count(*) AS assertions FROM kept GROUP BY 1) k JOIN (SELECT predicate, count(*) AS entities FROM n GROUP BY 1) USING (predicate)""")
def k8_topics(spark, d):
    return memory.knowledge_graph(assertions(spark, d), POLICY)["topics"]


@job("k8_kg_rejected", f"{KG} SELECT idx, id, CASE WHEN NOT ok THEN 'predicate' ELSE 'duplicate' END AS reason FROM r WHERE NOT ok OR rk > 1")
def k8_rejected(spark, d):
    return memory.knowledge_graph(assertions(spark, d), POLICY)["rejected"].select("idx", "id", "reason")


def records(spark, d):
    f = memory.errors(fragments(spark, d))
    return f.select("idx", F.concat(F.lit("r"), (F.col("idx") % 800).cast("string")).alias("record_id"), F.col("id").alias("fragment_id"), "errors")


REC = f"""{FR}, rec AS (SELECT idx, 'r' || (idx % 800) AS record_id, id AS fragment_id FROM frs WHERE ok),
rec1 AS (SELECT * FROM rec QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY idx) = 1), kept AS (SELECT * FROM rec1 QUALIFY row_number() OVER (PARTITION BY fragment_id ORDER BY idx) = 1)"""


@job("k9_first_records", f"{REC} SELECT idx, record_id, fragment_id FROM kept")
def k9(spark, d):
    return memory.first_records(records(spark, d)).select("idx", "record_id", "fragment_id")


@job("k10_kg_projection", f"""{REC}, dr AS (SELECT o_orderkey AS idx, 'd' || (o_orderkey % 5000) AS id, 'r' || (o_orderkey % 900) AS record_id, CASE WHEN o_orderkey % 3 = 0 THEN 'f' || (o_orderkey % 900 % 700) END AS fragment_id FROM orders),
j AS (SELECT dr.*, a.fragment_id AS own, b.record_id AS holder FROM dr LEFT JOIN kept a ON a.record_id = dr.record_id LEFT JOIN kept b ON b.fragment_id = dr.fragment_id)
SELECT idx, id, record_id, fragment_id FROM j WHERE own IS NOT NULL AND (fragment_id IS NULL OR (holder IS NOT NULL AND own = fragment_id)) QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1""")
def k10(spark, d):
    n = F.col("o_orderkey")
    text = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    drafts = read(spark, d, "orders").select(n.alias("idx"), text("d", n % 5000).alias("id"), text("r", n % 900).alias("record_id"), F.when(n % 3 == 0, text("f", n % 900 % 700)).alias("fragment_id"))
    return memory.kg_projection(memory.first_records(records(spark, d)), drafts)


@job("k11_retention", f"""{REC}, cm AS (SELECT event_id AS idx, 'c' || (event_id % 7000) AS id, 'r' || (k * 9) AS record_id, CASE event_type WHEN 'error' THEN 'archive' WHEN 'signup' THEN 'restore' ELSE 'request_consolidation' END AS kind
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),
o AS (SELECT * FROM cm WHERE record_id IN (SELECT record_id FROM kept) QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1),
l AS (SELECT record_id, arg_max(kind, idx) FILTER (kind <> 'request_consolidation') AS last, bool_or(kind = 'request_consolidation') AS asked FROM o GROUP BY 1)
SELECT record_id, CASE WHEN last = 'archive' THEN 'archived' ELSE 'active' END AS state, coalesce(asked, false) AS consolidate FROM kept LEFT JOIN l USING (record_id)""")
def k11(spark, d):
    kind = F.when(F.col("event_type") == "error", "archive").when(F.col("event_type") == "signup", "restore").otherwise("request_consolidation")
    e = events(spark, d)
    commands = e.select(F.col("event_id").alias("idx"), F.concat(F.lit("c"), (F.col("event_id") % 7000).cast("string")).alias("id"), F.concat(F.lit("r"), (F.col("k") * 9).cast("string")).alias("record_id"), kind.alias("kind"))
    return memory.retention(memory.first_records(records(spark, d)), commands).select("record_id", "state", "consolidate")


@job("k12_consolidation", f"""{E}, o AS (SELECT event_id AS idx, 'o' || (event_id % 6000) AS id, 'q' || k AS request_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'proposed' END AS state FROM e),
rq AS (SELECT 'q' || k AS request_id, arg_max(user_id, event_id) AS record_id FROM e WHERE event_type = 'signup' AND k % 3 > 0 GROUP BY 1)
SELECT o.idx, o.id, rq.record_id, CASE WHEN rq.request_id IS NULL THEN 'unknown-request' ELSE state END AS status FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY id ORDER BY idx) = 1) o LEFT JOIN rq USING (request_id)""")
def k12(spark, d):
    e = events(spark, d)
    q = F.concat(F.lit("q"), F.col("k").cast("string")).alias("request_id")
    requests = e.where((F.col("event_type") == "signup") & (F.col("k") % 3 > 0)).select(F.col("event_id").alias("idx"), q, F.col("user_id").alias("record_id"))
    outcomes = e.select(F.col("event_id").alias("idx"), F.concat(F.lit("o"), (F.col("event_id") % 6000).cast("string")).alias("id"), q, F.when(F.col("event_type") == "error", "failed").otherwise("proposed").alias("state"))
    return memory.consolidation(requests, outcomes).select("idx", "id", "record_id", "status")


PACK = """WITH j AS (SELECT source AS ctx, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank, '[f' || doc_id || '] ' || text AS part FROM documents),
s AS (SELECT *, sum(length(part)) OVER w + 3 * (count(part) OVER w - 1) AS size FROM j WINDOW w AS (PARTITION BY ctx ORDER BY rank)),
c AS (SELECT *, max(CASE WHEN part IS NOT NULL AND size > {0} THEN 1 ELSE 0 END) OVER (PARTITION BY ctx ORDER BY rank) AS ov FROM s)
SELECT ctx, coalesce(string_agg(CASE WHEN ov = 0 THEN part END, ' | ' ORDER BY rank), '') AS text, CAST(sum(CASE WHEN ov = 0 AND part IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, max(ov) = 1 AS truncated FROM c GROUP BY ctx"""


def packed(spark, d, budget):
    """Every document and its whole text, by source; documents without a text are missing ones."""
    docs = read(spark, d, "documents")
    fid = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fragment_id")
    ranked = number(docs.select("source", "doc_id"), ["doc_id"], ["source"], F.floor(F.col("doc_id") / 1000), "rank")
    entries = ranked.select(F.col("source").alias("ctx"), F.col("rank").cast("int").alias("rank"), fid)
    return memory.pack_context(entries, docs.where("text IS NOT NULL").select(F.col("doc_id").alias("idx"), fid, "text"), budget, " | ", True, ["ctx"])


@job("k13_pack_context", PACK.format(100_000))
def k13(spark, d):
    return packed(spark, d, 100_000)


@job("k13_pack_whole_texts", PACK.format(20_000))
def k13_whole(spark, d):
    return packed(spark, d, 20_000)


EDGES = "ed AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def edges(spark, d):
    t = lambda table, a, x, b, y: read(spark, d, table).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return t("customer", "c", "c_custkey", "n", "c_nationkey").union(t("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(t("nation", "n", "n_nationkey", "r", "n_regionkey"))


FROM_ALL = f"""WITH {EDGES}, d1 AS (SELECT src AS source, dst AS node FROM ed), d2 AS (SELECT d1.source, ed.dst AS node FROM d1 JOIN ed ON ed.src = d1.node)
SELECT source, node, 1 AS depth FROM (SELECT DISTINCT * FROM d1 WHERE source LIKE 's%') UNION ALL SELECT source, node, 2 FROM (SELECT DISTINCT * FROM d2 WHERE source LIKE 's%')"""


@job("g1_reachable", FROM_ALL)
@job("g1_reachable_from_all", FROM_ALL)
def g1_all(spark, d):
    """Downwards from every supplier."""
    sources = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graphs.reachable(edges(spark, d), sources, "down")


@job("g1_reachable_nations", f"""WITH RECURSIVE {EDGES}, u AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
b AS (SELECT 'n' || n_nationkey AS source, 'n' || n_nationkey AS node, 0 AS depth FROM nation UNION SELECT source, u.b, depth + 1 FROM b JOIN u ON u.a = b.node WHERE depth < 3)
SELECT source, node, min(depth) AS depth FROM b WHERE node <> source GROUP BY 1, 2""")
def g1_nations(spark, d):
    """In both directions from every nation."""
    sources = read(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    return graphs.reachable(edges(spark, d), sources, "both", 3)


ALL_PATHS = f"""WITH {EDGES}, q AS (SELECT 's' || s_suppkey AS source, 'r' || r_regionkey AS target FROM supplier, region),
w AS (SELECT DISTINCT x.src AS source, x.dst AS mid, y.dst AS target FROM ed x JOIN ed y ON y.src = x.dst WHERE x.src LIKE 's%')
SELECT q.source, q.target, w.source || '>' || mid || '>' || w.target AS path, CASE WHEN w.source IS NULL THEN 'no path' ELSE 'ok' END AS reason FROM q LEFT JOIN w USING (source, target)"""


@job("g2_explain_path", ALL_PATHS)
@job("g2_explain_all_paths", ALL_PATHS)
def g2_all(spark, d):
    """Downwards from every supplier to every region."""
    sources = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source"))
    pairs = sources.crossJoin(read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target")))
    return graphs.shortest_paths(edges(spark, d), pairs).select("source", "target", F.array_join("path", ">").alias("path"), "reason")


@job("g1_cut_short", f"WITH {EDGES} SELECT DISTINCT x.src AS source FROM ed x JOIN ed y ON y.src = x.dst WHERE x.src LIKE 's%'")
def g1_cut(spark, d):
    """Suppliers from which one step down is not all."""
    sources = read(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))
    return graphs.cut_short(edges(spark, d), sources, "down", 1)


@job("g2_path_reasons", f"""WITH {EDGES}, q AS (SELECT 's' || s_suppkey AS source, 'r' || r_regionkey AS target FROM supplier, region UNION ALL SELECT 'n' || n_nationkey, 'c1' FROM nation UNION ALL SELECT 'gone', 'r0' UNION ALL SELECT 's1', 'nowhere'),
nd AS (SELECT src AS id FROM ed UNION SELECT dst FROM ed), w AS (SELECT DISTINCT source FROM (SELECT x.src AS source FROM ed x JOIN ed y ON y.src = x.dst))
SELECT source, target, CASE WHEN source NOT IN (SELECT id FROM nd) THEN 'no such source' WHEN target NOT IN (SELECT id FROM nd) THEN 'no such target' WHEN source IN (SELECT source FROM w) THEN 'depth exceeded' ELSE 'no path' END AS reason FROM q""")
def g2_reasons(spark, d):
    """One step down is too little for suppliers, whose nations go on to regions, and all there is for nations."""
    e = edges(spark, d)
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("target"))
    s, n = (read(spark, d, t).select(F.concat(F.lit(t[0]), F.col(c).cast("string")).alias("source")) for t, c in (("supplier", "s_suppkey"), ("nation", "n_nationkey")))
    r = read(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("target"))  # five rows
    odd = e.limit(1).select(F.explode(F.array(pair(F.lit("gone"), F.lit("r0")), pair(F.lit("s1"), F.lit("nowhere")))).alias("p")).select("p.*")
    pairs = s.crossJoin(F.broadcast(r)).union(n.withColumn("target", F.lit("c1"))).union(odd)
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst"))
    return graphs.shortest_paths(e, pairs, "down", 1, nodes).select("source", "target", "reason")


@job("g3_islands", "SELECT 'c' || c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def g3(spark, d):
    urgent = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    o = read(spark, d, "orders").where(urgent).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("dst"))
    nodes = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return graphs.islands(nodes, o)


@job("g4_topology_diff", f"""WITH {EDGES}, n0 AS (SELECT c_custkey AS i, 'c' || c_custkey AS id, c_mktsegment AS meta FROM customer WHERE c_custkey % 5 > 0), n1 AS (SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_mktsegment END AS meta FROM customer WHERE c_custkey % 7 > 0),
e0 AS (SELECT * FROM ed WHERE dst NOT LIKE 'r%'), e1 AS (SELECT * FROM ed WHERE src NOT LIKE 'c1%')
SELECT CASE WHEN n0.id IS NULL THEN 'node added' WHEN n1.id IS NULL THEN 'node removed' ELSE 'meta changed' END AS change, coalesce(n0.id, n1.id) AS a, NULL AS b FROM n0 FULL JOIN n1 ON n0.id = n1.id WHERE n0.meta IS DISTINCT FROM n1.meta
UNION ALL SELECT 'edge removed', src, dst FROM (SELECT * FROM e0 EXCEPT SELECT * FROM e1) UNION ALL SELECT 'edge added', src, dst FROM (SELECT * FROM e1 EXCEPT SELECT * FROM e0)""")
def g4(spark, d):
    c = read(spark, d, "customer")
    cid = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id")
    before = c.where("c_custkey % 5 > 0").select(cid, F.col("c_mktsegment").alias("meta"))
    after = c.where("c_custkey % 7 > 0").select(cid, F.when(F.col("c_custkey") % 11 == 0, "X").otherwise(F.col("c_mktsegment")).alias("meta"))
    e = edges(spark, d)
    return graphs.diff((before, e.where(~F.col("dst").startswith("r"))), (after, e.where(~F.col("src").startswith("c1"))))


#: Customers under their nations under their regions; nations are named, but every third; regions are known by their first customer's prefix.
NESTED = """WITH c AS (SELECT c_custkey AS n, c_nationkey AS nk, n_regionkey AS rk, c_mktsegment AS seg FROM customer JOIN nation ON n_nationkey = c_nationkey),
nn AS (SELECT n_nationkey AS nk, n_regionkey AS rk, n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS idx FROM nation),
b AS (SELECT 'c' || n AS id, seg AS meta, nk, rk FROM c WHERE rk <> 4 UNION ALL SELECT 'R' || n_regionkey || '::hub', 'hub', NULL, n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey <> 4),
a AS (SELECT 'c' || n AS id, CASE WHEN n % 11 = 0 THEN 'X' ELSE seg END AS meta, nk, rk FROM c WHERE rk <> 0 AND nk <> 7 UNION ALL SELECT 'R' || n_regionkey || '::hub', 'hub', NULL, n_regionkey FROM (SELECT DISTINCT n_regionkey FROM nation) WHERE n_regionkey <> 0),
pb AS (SELECT 'R' || rk AS path FROM (SELECT DISTINCT rk FROM nn) WHERE rk <> 4 UNION ALL SELECT CASE WHEN nk % 3 > 0 THEN name ELSE 'R' || rk || '/' || idx END FROM nn WHERE rk <> 4),
pa AS (SELECT 'R' || rk AS path FROM (SELECT DISTINCT rk FROM nn) WHERE rk <> 0 UNION ALL SELECT CASE WHEN nk % 3 > 0 THEN name ELSE 'R' || rk || '/' || idx END FROM nn WHERE rk <> 0 AND nk <> 7),
eb AS (SELECT 'R' || rk || '::hub' AS src, id AS dst FROM b WHERE nk IS NOT NULL), ea AS (SELECT 'R' || rk || '::hub' AS src, id AS dst FROM a WHERE nk IS NOT NULL)
SELECT CASE WHEN b.id IS NULL THEN 'node added' WHEN a.id IS NULL THEN 'node removed' ELSE 'meta changed' END AS change, coalesce(b.id, a.id) AS a, NULL AS b FROM b FULL JOIN a ON a.id = b.id WHERE a.meta IS DISTINCT FROM b.meta
UNION ALL SELECT 'edge added', src, dst FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) UNION ALL SELECT 'edge removed', src, dst FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea)
UNION ALL SELECT 'subgraph mounted', path, NULL FROM (SELECT * FROM pa EXCEPT SELECT * FROM pb) UNION ALL SELECT 'subgraph unmounted', path, NULL FROM (SELECT * FROM pb EXCEPT SELECT * FROM pa)"""


@job("g4_nested_diff", NESTED)
def g4_nested(spark, d):
    """Regions hold nations, nations customers: one region leaves, one comes, a nation is unmounted inside another, and metas change."""
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("nk"), F.col("n_regionkey").alias("rk"), F.col("n_name").alias("name"))
    customers = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.col("c_nationkey").alias("nk"), F.col("c_mktsegment").alias("seg")).join(nations.drop("name"), "nk")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    hub = F.concat(text("R", "rk"), F.lit("::hub"))
    idx = (F.row_number().over(over(["rk"], ["nk"])) - 1).alias("idx")

    def snapshot(without: int, unmounted: int, meta):
        inside, regions = customers.where((F.col("rk") != without) & (F.col("nk") != unmounted)), nations.select("rk").distinct().where(F.col("rk") != without)
        nodes = inside.select(text("n", "nk").alias("subgraph"), "n", text("c", "n").alias("id"), meta.alias("meta")).union(regions.select(text("r", "rk").alias("subgraph"), F.lit(0), hub, F.lit("hub")))
        edges = inside.select(text("r", "rk").alias("subgraph"), hub.alias("src"), text("c", "n").alias("dst"))
        named = F.when(F.col("nk") % 3 > 0, F.col("name"))
        inner = nations.select("nk", "rk", text("n", "nk").alias("subgraph"), text("r", "rk").alias("parent"), idx, named.alias("name")).where((F.col("rk") != without) & (F.col("nk") != unmounted))
        none = F.lit(None).cast("string")
        outer = regions.select(text("r", "rk").alias("subgraph"), none.alias("parent"), F.col("rk").alias("idx"), none.alias("name"))
        return nodes, edges, outer.union(inner.select("subgraph", "parent", F.col("idx").cast("int"), "name"))

    before = snapshot(4, -1, F.col("seg"))
    return graphs.nested_diff(before, snapshot(0, 7, F.when(F.col("n") % 11 == 0, "X").otherwise(F.col("seg"))))


@job("g5_profile_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def g5(spark, d):
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 97).alias("invokes"))
    return graphs.profile(nodes, 10)[0]


@job("g5_profile_hot", "SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey % 97 AS invokes FROM orders ORDER BY invokes DESC, path LIMIT 10")
def g5_hot(spark, d):
    nodes = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 97).alias("invokes"))
    return graphs.profile(nodes, 10)[1].select("path", "invokes")


@job("x1_backoff", """WITH a AS (SELECT event_id, event_id % 8 + 1 AS n FROM events)
SELECT event_id, CAST(25 AS BIGINT) AS constant, least(10 + 5 * (n - 1), 18) AS linear, CAST(least(10 * 2 ** (n - 1), 500) AS BIGINT) AS exponential, CAST(10 * [1, 1, 2, 3, 5, 8, 13, 21][n] AS BIGINT) AS fibonacci, CAST(0 AS BIGINT) AS none FROM a""")
def x1(spark, d):
    n = F.col("event_id") % 8 + 1
    b = resilience.backoff_ms
    return events(spark, d).select(
        "event_id", b("constant", n, 25).alias("constant"), b("linear", n, 10, 5, cap=18).alias("linear"), b("exponential", n, 10, cap=500).alias("exponential"),
        b("fibonacci", n, 10).alias("fibonacci"), b("none", n).alias("none"),
    )


@job("x2_retry", "WITH a AS (SELECT event_id, event_id % 6 AS f FROM events) SELECT event_id, f < 4 AS again, CASE WHEN f + 1 <= 4 THEN 100 + 50 * f END AS delay_ms FROM a")
def x2(spark, d):
    f = F.col("event_id") % 6
    return events(spark, d).select("event_id", resilience.should_retry(f, 4).alias("again"), resilience.next_delay_ms(f, 4, kind="linear", initial=100, step=50).alias("delay_ms"))


RETRY = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'view' THEN 'retry' ELSE 'attempt' END"


@job("x3_retry_status", f"""{E} SELECT user_id, CASE arg_max({RETRY}, (ms, event_id)) WHEN 'attempt' THEN 'running' WHEN 'retry' THEN 'waiting' WHEN 'success' THEN 'succeeded' ELSE 'failed' END AS status FROM e GROUP BY user_id""")
def x3(spark, d):
    return resilience.retry_status(events(spark, d).withColumn("kind", F.expr(RETRY)), "kind", ORDER, KEY)


@job("x4_breaker", f"""{E}, i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER {W} AS isl FROM e),
f AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER v AS failures, last_value(CASE WHEN event_type = 'error' THEN ms END IGNORE NULLS) OVER v AS failed_at FROM i WINDOW v AS (PARTITION BY user_id, isl ORDER BY ms, event_id))
SELECT event_id, CAST(failures AS BIGINT) AS failures, failures >= 3 AS open, CASE WHEN failures >= 3 THEN failed_at END AS opened_at FROM f""")
def x4(spark, d):
    kind = F.col("event_type")
    return resilience.breaker(events(spark, d), kind == "error", kind == "purchase", 3, "ms", ORDER, KEY).select("event_id", "failures", "open", "opened_at")


@job("s4_cron_matches", """SELECT event_id, minute(ts) IN (0, 15, 30, 45) AND hour(ts) BETWEEN 9 AND 17 AND (day(ts) IN (1, 15) OR dayofweek(ts) IN (1, 3)) AS due FROM events""")
def s4(spark, d):
    return read(spark, d, "events").select("event_id", cron.matches(F.col("ts"), "*/15 9-17 1,15 * 1,3").alias("due"))


@job("s4_cron_calendar", """SELECT DISTINCT o.o_orderdate AS day, CAST(g AS TIMESTAMP) AS at FROM (SELECT DISTINCT o_orderdate FROM orders) o, generate_series(o_orderdate, o_orderdate + INTERVAL 23 HOUR, INTERVAL 1 HOUR) t(g) WHERE hour(g) IN (6, 18) AND dayofweek(g) BETWEEN 1 AND 5""")
def s4_calendar(spark, d):
    days = read(spark, d, "orders").select(F.col("o_orderdate").alias("day")).distinct()
    ticks = days.withColumn("at", F.explode(F.expr("sequence(day, day + INTERVAL 23 HOUR, INTERVAL 1 HOUR)")))
    return ticks.where(cron.matches(F.col("at"), "0 6,18 * * 1-5"))


@job("u4_canonical_ids", """SELECT event_id, 'admission:["' || event_type || '","' || user_id || '"]' AS key, regexp_full_match(CAST(event_id - 5 AS VARCHAR), '0|-?[1-9][0-9]*') AS is_integer,
regexp_full_match(CAST(event_id - 5 AS VARCHAR), '0|[1-9][0-9]*') AS is_natural, 'ctx:' || sha256('{"a":' || user_id || ',"b":"' || event_type || '"}') AS address FROM events""")
def u4(spark, d):
    text = (F.col("event_id") - 5).cast("string")
    context = ids.canonical_json(b=F.col("event_type"), a=F.col("user_id"))
    return read(spark, d, "events").select(
        "event_id", ids.prefixed_key("admission", "event_type", "user_id").alias("key"), ids.is_integer_string(text).alias("is_integer"),
        ids.is_natural_string(text).alias("is_natural"), ids.content_key("ctx:", context).alias("address"),
    )


@job("k14_record_frames", f"""{FR}, rec AS (SELECT idx, 'r' || (idx % 800) AS record_id, id AS fragment_id, tags[1] AS lang, idx // 100 AS seq FROM fr), m AS (SELECT lang, max(seq) AS cursor FROM rec GROUP BY 1)
SELECT rec.lang, cursor, idx, record_id, fragment_id FROM rec JOIN m ON rec.lang = m.lang AND seq = cursor""")
def k14(spark, d):
    f = fragments(spark, d)
    rows = f.select("idx", F.concat(F.lit("r"), (F.col("idx") % 800).cast("string")).alias("record_id"), F.col("id").alias("fragment_id"), F.col("tags")[0].alias("lang"))
    return memory.load_records(memory.record_frames(rows, ["lang"], F.floor(F.col("idx") / 100)), ["lang"])
