"""Registered queries over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from winnowlane.functions import capture, signature, text
from winnowlane.operators import geo, hierarchy, order, organize, ranking, results, similarity, staged, stats, tags
from winnowlane.session import table
from winnowlane.sources import adapters, files, sinks

_FOUND: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def keep(f):
        _FOUND[f.__name__] = (f, sql)
        return f

    return keep


SHOTS = """shots AS (SELECT event_id AS id, ts, user_id AS unit, CASE WHEN event_id % 10 <> 0 THEN event_type END AS camera, value,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  CASE WHEN event_id % 9 <> 0 THEN CAST((user_id * 37) % 120 - 60 + (event_id % 7) * CAST(0.01 AS DOUBLE) AS DOUBLE) END AS lat,
  CASE WHEN event_id % 9 <> 0 THEN CAST((user_id * 53) % 300 - 150 + (event_id % 5) * CAST(0.01 AS DOUBLE) AS DOUBLE) END AS lon FROM events)"""
FOLDERS = """folders AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 THEN r_name || '/' || n_name || '/' || c_mktsegment ELSE r_name || '/' || n_name END AS dir, c_acctbal AS score
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PATHS = """, parts AS (SELECT id, dir, string_split(dir, '/') AS p FROM folders), prefixes AS (SELECT id, dir, unnest(range(0, len(p) + 1)) AS d, p FROM parts),
  tops AS (SELECT id, dir, d, array_to_string(p[1:d], '/') AS path FROM prefixes)"""


def _bits(lo: int, hi: int) -> str:
    return " + ".join(f"CASE WHEN embedding[{i + 1}] > med THEN {1 << (31 - i % 32)} ELSE 0 END" for i in range(max(lo, 1), hi))


SIGS = f"""meds AS (SELECT vec_id AS id, label AS unit, embedding, list_sort(embedding[2:64])[32] AS med FROM embeddings),
  sigs AS (SELECT id, unit, CAST({_bits(0, 32)} AS BIGINT) AS hi, CAST({_bits(32, 64)} AS BIGINT) AS lo FROM meds)"""
PAIRS = SIGS + ", pairs AS (SELECT a.unit, a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM sigs a JOIN sigs b ON a.unit = b.unit AND a.id < b.id)"


# ---- grouping and events


@query(f"WITH {SHOTS} SELECT strftime(ts, '%Y-%m-%d') || '/' || coalesce(camera, 'Unknown camera') AS group_key, count(*) AS n FROM shots GROUP BY 1")
def organize_day_type(spark, d):
    s = adapters.shots(spark, d)
    return organize.group_counts(s, {"day": F.date_format("ts", "yyyy-MM-dd"), "camera": F.col("camera")})


@query(f"""WITH {SHOTS}, c AS (SELECT unnest(['day', 'camera', 'location']) AS category, unnest([strftime(ts, '%Y-%m-%d'), camera, CASE WHEN lat IS NOT NULL THEN CAST(k AS VARCHAR) END]) AS v FROM shots)
SELECT category, count(DISTINCT v) AS n_values, count(*) - count(v) AS n_missing, count(DISTINCT v) + CASE WHEN count(*) > count(v) THEN 1 ELSE 0 END AS n_groups FROM c GROUP BY 1""")
def category_summary(spark, d):
    s = adapters.shots(spark, d)
    place = F.when(capture.has_position(F.col("lat"), F.col("lon")), F.col("k").cast("string"))
    return organize.category_summary(s, {"day": F.date_format("ts", "yyyy-MM-dd"), "camera": F.col("camera"), "location": place})


def _gap_sql(by: str, hours: float) -> str:
    part = f"PARTITION BY {by} " if by else ""
    head = f"{by}, " if by else ""
    return f"""WITH {SHOTS}, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({part}ORDER BY ts, id)) <= {int(hours * 3.6e9)} THEN 0 ELSE 1 END AS s FROM shots),
n AS (SELECT *, sum(s) OVER ({part}ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS event_no FROM g)
SELECT {head}CAST(event_no AS BIGINT) AS event_no, strftime(min(ts), '%Y-%m-%d %H.%M') AS label, count(*) AS n FROM n GROUP BY {head}event_no"""


@query(_gap_sql("unit", 6))
def gap_events(spark, d):
    e = organize.gap_events(adapters.shots(spark, d), "ts", "id", 6, ["unit"])
    return organize.event_sizes(e, "ts", ["unit"]).select("unit", "event_no", F.date_format("started", "yyyy-MM-dd HH.mm").alias("label"), "n")


@query(_gap_sql("", 0.5))
def gap_events_global(spark, d):
    e = organize.gap_events(adapters.shots(spark, d), "ts", "id", 0.5)
    return organize.event_sizes(e, "ts").select("event_no", F.date_format("started", "yyyy-MM-dd HH.mm").alias("label"), "n")


@query(_gap_sql("unit", 6).replace("CAST(event_no AS BIGINT) AS event_no, ", ""))
def session_windows(spark, d):
    return organize.session_sizes(adapters.shots(spark, d), "ts", 6, ["unit"]).select("unit", F.date_format("started", "yyyy-MM-dd HH.mm").alias("label"), "n")


@query(f"WITH {SHOTS} SELECT id, row_number() OVER (ORDER BY camera IS NULL, camera, ts, id) AS ord FROM shots")
def missing_groups_last(spark, d):
    s = adapters.shots(spark, d).withColumn("g", organize.group_key(None, {"camera": F.col("camera")}))
    placed = order.positions(s.select("id", "ts", "g"), None, [*organize.missing_last(F.col("g")), *organize.time_order()])
    return placed.select("id", (F.col("pos") + 1).alias("ord"))


# ---- trees and quotas


@query(f"WITH {FOLDERS}{PATHS} SELECT path, count(*) AS n FROM tops GROUP BY 1")
def tree_rollup(spark, d):
    return hierarchy.rollup_counts(adapters.customers_in_folders(spark, d))


@query(f"WITH {FOLDERS}{PATHS} SELECT path, count(*) AS n FROM tops WHERE dir <> 'ASIA' AND NOT starts_with(dir, 'ASIA/') AND dir <> 'AFRICA/NATION_5' AND NOT starts_with(dir, 'AFRICA/NATION_5/') GROUP BY 1")
def tree_counts_excluding(spark, d):
    rows = adapters.customers_in_folders(spark, d)
    shut = spark.createDataFrame([("ASIA",), ("AFRICA/NATION_5",)], "path string")
    return hierarchy.rollup_counts(hierarchy.outside(rows, shut))


NODES = FOLDERS + """, moved AS (SELECT id, dir, CASE WHEN id % 10 = 0 AND EXISTS (SELECT 1 FROM folders f WHERE starts_with(f.dir, folders.dir || '/')) THEN dir || '/__loose__' ELSE dir END AS node FROM folders),
  parts AS (SELECT node, string_split(node, '/') AS p FROM (SELECT DISTINCT node FROM moved)), tops AS (SELECT DISTINCT array_to_string(p[1:d], '/') AS path FROM (SELECT p, unnest(range(0, len(p) + 1)) AS d FROM parts)),
  own AS (SELECT node, count(*) AS n FROM moved GROUP BY 1),
  nodes AS (SELECT path, CASE WHEN path = '' THEN NULL WHEN path NOT LIKE '%/%' THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS parent_path, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth,
    coalesce(n, 0) AS own_count, path LIKE '%\\_\\_loose\\_\\_' ESCAPE '\\' AS synthetic FROM tops LEFT JOIN own ON node = path)"""


@query(f"WITH {NODES} SELECT path, parent_path, CAST(depth AS INTEGER) AS depth, own_count, synthetic FROM nodes")
def tree_nodes(spark, d):
    return hierarchy.tree(adapters.customers_in_folders(spark, d))[0]


QUOTAS = [("", "900"), ("AFRICA", "40"), ("AFRICA/NATION_0", "10%"), ("AFRICA/NATION_5", "0"), ("AFRICA/NATION_10", "5000"), ("AMERICA", "*"), ("AMERICA/NATION_1", "7"), ("ASIA", "30"), ("ASIA/NATION_2", "25"), ("ASIA/NATION_7", "25"), ("ASIA/NATION_2/BUILDING", "3"), ("EUROPE", "5%"), ("EUROPE/NATION_3", "*")]
VALUES = ", ".join(f"('{p}', '{q}')" for p, q in QUOTAS)
RESOLVED = NODES + f""", raw(path, raw) AS (VALUES {VALUES}),
  q AS (SELECT path, CASE WHEN raw = '' THEN 'pooled' WHEN raw = '*' THEN 'uncapped' WHEN raw IN ('0', '0%') THEN 'excluded' WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' ELSE 'fixed' END AS mode, TRY_CAST(replace(raw, '%', '') AS DOUBLE) AS value FROM raw),
  a AS (SELECT n.*, coalesce(q.mode, 'pooled') AS mode, q.value FROM nodes n LEFT JOIN q USING (path)),
  x AS (SELECT a.*, EXISTS (SELECT 1 FROM a e WHERE e.mode = 'excluded' AND (a.path = e.path OR starts_with(a.path, e.path || '/'))) AS excluded FROM a),
  y AS (SELECT x.*, CASE WHEN excluded THEN 0 ELSE (SELECT sum(o.own_count) FROM x o WHERE NOT o.excluded AND (x.path = '' OR o.path = x.path OR starts_with(o.path, x.path || '/'))) END AS subtree FROM x),
  z AS (SELECT y.*, CASE WHEN mode = 'percent' THEN 'fixed' ELSE mode END AS em, CASE WHEN mode = 'percent' THEN CASE WHEN subtree > 0 THEN greatest(1, least(subtree, floor(value / 100 * subtree + 0.5))) ELSE 0 END ELSE value END AS ev,
    NOT EXISTS (SELECT 1 FROM y k WHERE k.parent_path = y.path AND NOT k.excluded) AS leaf FROM y),
  t AS (SELECT z.*, CASE WHEN excluded THEN 0 WHEN em = 'fixed' AND leaf THEN least(ev, subtree) WHEN em = 'fixed' THEN ev END AS target FROM z),
  k AS (SELECT parent_path AS path, sum(CASE WHEN em = 'fixed' THEN coalesce(target, 0) ELSE 0 END) AS fs, count_if(em = 'uncapped') AS uk, count_if(em = 'pooled') AS pk, sum(CASE WHEN em = 'pooled' THEN subtree ELSE 0 END) AS pc FROM t WHERE NOT excluded AND parent_path IS NOT NULL GROUP BY 1),
  r AS (SELECT t.*, fs, uk, pk, pc, CASE WHEN NOT excluded AND NOT leaf AND em = 'fixed' AND fs <= ev THEN ev - fs END AS remainder FROM t LEFT JOIN k USING (path)),
  u AS (SELECT 'uncapped' AS kind, path, NULL AS tgt FROM r WHERE NOT excluded AND leaf AND em = 'uncapped' AND subtree > 0 UNION ALL SELECT 'fixed', path, target FROM r WHERE NOT excluded AND leaf AND em = 'fixed' AND target > 0
    UNION ALL SELECT 'pooled', path, least(remainder, pc) FROM r WHERE remainder IS NOT NULL AND pk > 0 AND least(remainder, pc) > 0)"""


def _quotas(spark, d):
    nodes, held = hierarchy.tree(adapters.customers_in_folders(spark, d))
    resolved = hierarchy.resolve(nodes, spark.createDataFrame(QUOTAS, "path string, raw string"))
    return held, resolved, hierarchy.units(resolved)


@query(f"WITH {RESOLVED} SELECT kind || ':' || CASE WHEN path = '' THEN 'root' ELSE path END AS unit_id, kind, path AS owner_path, CAST(tgt AS BIGINT) AS target FROM u")
def alloc_resolve_units(spark, d):
    return _quotas(spark, d)[2]


@query(f"""WITH {RESOLVED}, pooled AS (SELECT c.path, p.em AS pm, least(p.remainder, p.pc) AS ps, EXISTS (SELECT 1 FROM r low WHERE NOT low.excluded AND low.em IN ('fixed', 'uncapped') AND starts_with(low.path, c.path || '/')) AS busy FROM r c JOIN r p ON c.parent_path = p.path WHERE NOT c.excluded AND NOT p.excluded AND c.em = 'pooled')
SELECT path, 'warn' AS level, 'clamped' AS code FROM r WHERE NOT excluded AND leaf AND em = 'fixed' AND ev > subtree UNION ALL SELECT path, 'error', 'dead-pool' FROM pooled WHERE pm = 'uncapped' AND NOT busy
UNION ALL SELECT path, 'error', 'oversubscribed' FROM r WHERE NOT excluded AND NOT leaf AND em = 'fixed' AND remainder IS NULL UNION ALL SELECT path, 'error', 'uncapped-under-fixed' FROM r WHERE remainder IS NOT NULL AND uk > 0
UNION ALL SELECT path, 'warn', 'pool-clamped' FROM r WHERE remainder IS NOT NULL AND pk > 0 AND remainder > pc UNION ALL SELECT path, 'warn', 'no-remainder' FROM pooled WHERE pm = 'fixed' AND ps = 0 UNION ALL SELECT path, 'note', 'unused-remainder' FROM r WHERE remainder IS NOT NULL AND pk = 0 AND remainder > 0""")
def alloc_issues(spark, d):
    _, resolved, found = _quotas(spark, d)
    return hierarchy.issues(resolved, found)


@query("SELECT '' AS path, 'note' AS level, 'root-unallocated' AS code FROM customer HAVING count(*) > 0")
def alloc_issues_bare(spark, d):
    """A tree without any quota: its root is told that no place is given out."""
    resolved = hierarchy.resolve(hierarchy.tree(adapters.customers_in_folders(spark, d))[0], spark.createDataFrame([], "path string, raw string"))
    return hierarchy.issues(resolved, hierarchy.units(resolved))


@query(f"""WITH {RESOLVED}, up AS (SELECT kind || ':' || CASE WHEN path = '' THEN 'root' ELSE path END AS unit_id, path FROM u WHERE kind <> 'pooled' UNION ALL SELECT 'pooled:' || CASE WHEN u.path = '' THEN 'root' ELSE u.path END, c.path FROM u JOIN r c ON c.parent_path = u.path AND NOT c.excluded AND c.em = 'pooled' WHERE u.kind = 'pooled')
SELECT unit_id, count(*) AS n FROM up JOIN r n ON NOT n.excluded AND (n.path = up.path OR starts_with(n.path, up.path || '/')) JOIN moved m ON m.node = n.path GROUP BY 1""")
def alloc_members(spark, d):
    held, resolved, found = _quotas(spark, d)
    return hierarchy.members(held, resolved, found).groupBy("unit_id").agg(F.count("*").alias("n"))


@query(f"WITH {RESOLVED} SELECT CASE WHEN count_if(tgt IS NULL) > 0 THEN NULL ELSE CAST(sum(tgt) AS BIGINT) END AS projected_total FROM u")
def alloc_total(spark, d):
    return hierarchy.projected_total(_quotas(spark, d)[2])


@query("""WITH x AS (SELECT *, p_partkey % 13 AS k FROM part) SELECT p_partkey AS id, CASE WHEN k IN (0, 1) THEN 'fixed' WHEN k = 2 THEN 'excluded' WHEN k = 3 THEN 'pooled' WHEN k IN (4, 5) THEN 'uncapped' WHEN k IN (6, 7) THEN 'percent' WHEN k = 8 AND p_size <= 30 THEN 'percent' WHEN k = 9 THEN 'excluded' ELSE 'invalid' END AS mode,
CASE WHEN k IN (0, 1, 6) THEN CAST(p_size AS DOUBLE) WHEN k = 7 THEN p_size + 0.5 WHEN k = 8 AND p_size <= 30 THEN p_size + 70.0 END AS value FROM x""")
def alloc_parse(spark, d):
    """Quotas in all the ways that they are typed, right and wrong."""
    k, n = F.col("p_partkey") % 13, F.col("p_size").cast("string")
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" 00"), n)).when(k == 2, "000").when(k == 3, F.when(F.col("p_size") % 2 == 0, " ")).when(k == 4, " * ").when(k == 5, "INF").when(k == 6, F.concat(n, F.lit(" %"))).when(k == 7, F.concat(n, F.lit(".5%")))
    raw = raw.when(k == 8, F.concat((F.col("p_size") + 70).cast("string"), F.lit("%"))).when(k == 9, "0%").when(k == 10, F.concat(F.lit("-"), n)).when(k == 11, F.concat(n, F.lit("%%"))).when(k == 12, F.concat(n, F.lit(".5")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), hierarchy.parse_quota(raw).alias("q")).select("id", "q.mode", "q.value")


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size > 0 AND p_partkey % 101 > 0 THEN greatest(1, least(p_size, floor((p_partkey % 101) / 100.0 * p_size + 0.5))) ELSE 0 END AS BIGINT) AS n FROM part")
def percent_count(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), hierarchy.percent_count((F.col("p_partkey") % 101).cast("double"), F.col("p_size")).alias("n"))


@query(f"""WITH {FOLDERS}{PATHS}, n AS (SELECT path, count(*) AS c FROM tops WHERE path <> '' AND dir <> 'ASIA' AND NOT starts_with(dir, 'ASIA/') GROUP BY 1), k AS (SELECT path, c, CASE WHEN path NOT LIKE '%/%' THEN '' ELSE regexp_replace(path, '/[^/]*$', '') END AS up,
  CAST(coalesce(nullif(regexp_extract(path, '_([0-9]+)$', 1), ''), '0') AS INTEGER) AS num FROM n WHERE len(string_split(path, '/')) < 3),
x AS (SELECT *, 10 * c / CAST(sum(c) OVER (PARTITION BY up) AS DOUBLE) AS e, row_number() OVER (PARTITION BY up ORDER BY regexp_replace(path, '[0-9]+$', ''), num) AS ord FROM k),
y AS (SELECT *, floor(e) AS fl, row_number() OVER (PARTITION BY up ORDER BY e - floor(e) DESC, ord) AS nth, 10 - sum(floor(e)) OVER (PARTITION BY up) AS spare FROM x)
SELECT path, CAST(fl + CASE WHEN nth <= spare THEN 1 ELSE 0 END AS BIGINT) AS places FROM y""")
def alloc_apportion(spark, d):
    """Shares of 10 among regions, and among the nations of each."""
    nodes = hierarchy.sibling_order(hierarchy.resolve(hierarchy.tree(adapters.customers_in_folders(spark, d))[0], spark.createDataFrame([("ASIA", "0")], "path string, raw string")))
    kids = nodes.where("parent_path IS NOT NULL AND NOT excluded AND depth < 3").select("parent_path", "path", "ord", "subtree_count")
    return hierarchy.apportion(kids, 10)


@query(f"""WITH RECURSIVE {FOLDERS}, k AS (SELECT string_split(dir, '/')[1] AS up, string_split(dir, '/')[2] AS name, count(*) AS c FROM folders GROUP BY 1, 2), n AS (SELECT up, name, c, CAST(coalesce(nullif(regexp_extract(name, '_([0-9]+)$', 1), ''), '0') AS INTEGER) AS num FROM k WHERE name IS NOT NULL),
l AS (SELECT up, list(name ORDER BY num) AS names, list(c ORDER BY num) AS caps, CAST(floor(0.9 * sum(c)) AS BIGINT) AS total FROM n GROUP BY 1),
s(up, names, caps, got, spare) AS (SELECT up, names, caps, list_transform(caps, lambda c, i: least(c, total // len(caps) + CASE WHEN i <= total % len(caps) THEN 1 ELSE 0 END)), total - list_sum(list_transform(caps, lambda c, i: least(c, total // len(caps) + CASE WHEN i <= total % len(caps) THEN 1 ELSE 0 END))) FROM l
 UNION ALL SELECT up, names, caps, now, CAST(spare - (list_sum(now) - list_sum(got)) AS HUGEINT) FROM (SELECT *, list_transform(got, lambda g, i: g + CASE WHEN g < caps[i] AND len(list_filter(range(1, i + 1), lambda j: got[j] < caps[j])) <= spare THEN 1 ELSE 0 END) AS now FROM s WHERE spare > 0))
SELECT up || '/' || unnest(names) AS path, CAST(unnest(got) AS BIGINT) AS places FROM s WHERE spare = 0""")
def alloc_apportion_even(spark, d):
    """Nine tenths of each region's rows in equal shares: what small nations can't take goes to the others."""
    nodes = hierarchy.sibling_order(hierarchy.resolve(hierarchy.tree(adapters.customers_in_folders(spark, d))[0], spark.createDataFrame([], "path string, raw string")))
    kids = nodes.where("depth = 2 AND NOT synthetic").select("parent_path", "path", "ord", "subtree_count")
    total = F.floor(0.9 * F.sum("subtree_count").over(Window.partitionBy("parent_path"))).cast("long")
    return hierarchy.apportion(kids.withColumn("total", total), "total", even=True)


# ---- similarity


@query(f"WITH {PAIRS} SELECT * FROM pairs WHERE distance <= 20")
def hamming_pairs(spark, d):
    return similarity.close_pairs(adapters.signatures(spark, d), 20)


@query(f"""WITH {SIGS}, twice AS (SELECT id, unit, hi, lo FROM sigs UNION ALL SELECT id + 10000000, unit, hi, xor(lo, CAST(1 + id % 7 AS BIGINT)) FROM sigs)
SELECT a.unit, a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM twice a JOIN twice b ON a.unit = b.unit AND a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 8""")
def hamming_pairs_banded(spark, d):
    """With a copy of every signature in which some low bits are turned, so that there are pairs."""
    s = adapters.signatures(spark, d)
    turned = s.select(F.col("id") + 10000000, "unit", "hi", F.col("lo").bitwiseXOR((F.lit(1) + F.col("id") % 7).cast("long")))
    return similarity.close_pairs(s.union(turned), 8)


@query(f"WITH {PAIRS} SELECT distance, count(*) AS n FROM pairs GROUP BY 1")
def hamming_hist(spark, d):
    return similarity.distance_counts(adapters.signatures(spark, d)).select("distance", F.col("neg").alias("n"))


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE distance <= 20 UNION SELECT b, a FROM pairs WHERE distance <= 20), w AS (SELECT id, id AS r FROM sigs UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.id)
SELECT s.unit, s.id, min(w.r) AS group_id FROM sigs s JOIN w ON w.id = s.id GROUP BY 1, 2""")
def union_clusters(spark, d):
    s = adapters.signatures(spark, d)
    return similarity.union_clusters(similarity.close_pairs(s, 20), s)


STRICT = f"""{SIGS}, q AS (SELECT unit, id, hi, lo, row_number() OVER (PARTITION BY unit ORDER BY id) AS i FROM sigs),
s(unit, i, g) AS (SELECT unit, CAST(0 AS BIGINT), CAST([] AS STRUCT(id BIGINT, hi BIGINT, lo BIGINT)[][]) FROM q GROUP BY 1 UNION ALL
 SELECT unit, i, CASE WHEN len(w) > 0 AND list_min(w) <= 20 THEN list_transform(g, lambda v, k: CASE WHEN k = list_position(w, list_min(w)) THEN list_append(v, r) ELSE v END) ELSE list_append(g, [r]) END
 FROM (SELECT s.unit, q.i, s.g, {{'id': q.id, 'hi': q.hi, 'lo': q.lo}} AS r, list_transform(s.g, lambda v: list_max(list_transform(v, lambda m: bit_count(xor(m.hi, q.hi)) + bit_count(xor(m.lo, q.lo))))) AS w FROM s JOIN q ON q.unit = s.unit AND q.i = s.i + 1)),
strict AS (SELECT CAST(unit AS VARCHAR) AS unit, m.id AS id, grp[1].id AS group_id FROM (SELECT unit, grp, unnest(grp) AS m FROM (SELECT unit, unnest(g) AS grp FROM s WHERE (unit, i) IN (SELECT unit, max(i) FROM q GROUP BY 1))))"""


@query(f"WITH RECURSIVE {STRICT} SELECT * FROM strict")
def strict_clusters(spark, d):
    return similarity.cluster(adapters.signatures(spark, d), 20)


@query(f"""WITH RECURSIVE {PAIRS}, e AS (SELECT a, b FROM pairs WHERE distance <= 20 UNION SELECT b, a FROM pairs WHERE distance <= 20), w AS (SELECT id, id AS r FROM sigs UNION SELECT e.b, w.r FROM w JOIN e ON e.a = w.id)
SELECT CAST(s.unit AS VARCHAR) AS unit, s.id, min(w.r) AS group_id FROM sigs s JOIN w ON w.id = s.id GROUP BY 1, 2""")
def union_clusters_folded(spark, d):
    return similarity.cluster(adapters.signatures(spark, d), 20, "union")


@query(f"""WITH RECURSIVE {STRICT}, n AS (SELECT *, row_number() OVER (PARTITION BY unit, group_id ORDER BY id) AS k, min(id) OVER (PARTITION BY unit) AS lo_id, max(id) OVER (PARTITION BY unit) AS hi_id FROM strict),
split AS (SELECT unit, id, lo_id, hi_id, CASE WHEN k = 2 THEN id ELSE group_id END AS g FROM n), ends AS (SELECT unit, max(CASE WHEN id = lo_id THEN g END) AS a, max(CASE WHEN id = hi_id THEN g END) AS b FROM split GROUP BY 1)
SELECT s.unit, s.id, CASE WHEN s.g IN (e.a, e.b) THEN least(e.a, e.b) ELSE s.g END AS group_id FROM split s JOIN ends e ON e.unit = s.unit""")
def corrected_clusters(spark, d):
    """Strict groups whose two least members are parted, and the first and last row of each unit tied together."""
    from pyspark.sql import Window

    s = adapters.signatures(spark, d).withColumn("unit", F.col("unit").cast("string"))
    g = similarity.cluster(s, 20)
    nth = F.row_number().over(Window.partitionBy("unit", "group_id").orderBy("id"))
    apart = g.withColumn("n", nth).where("n = 2").select(F.col("group_id").alias("a"), F.col("id").alias("b"), F.lit(-1).alias("sign"), F.lit(2).cast("long").alias("seq"))
    ends = s.groupBy("unit").agg(F.min("id").alias("a"), F.max("id").alias("b")).select("b", "a", F.lit(1).alias("sign"), F.lit(3).cast("long").alias("seq"))
    # an earlier edit of the same pairs that later ones take back
    first = apart.withColumn("sign", F.lit(1)).withColumn("seq", F.lit(1).cast("long"))
    return similarity.cluster(s, 20, "strict", similarity.last_edits(first.unionByName(apart).unionByName(ends)))


@query("""WITH m AS (SELECT p_brand AS g, p_partkey AS id, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) AS s, p_size / CAST(max(p_size) OVER (PARTITION BY p_brand) AS DOUBLE) AS p FROM part)
SELECT g, id FROM (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY 0.7 * s + 0.3 * p DESC, id) AS n FROM m) WHERE n = 1""")
def group_representative(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("sharp"), F.col("p_size").alias("pixels"))
    return similarity.representatives(p, ["g"]).select("g", "id")


@query(f"""WITH {PAIRS}, l AS (SELECT distance, (a + b) % 3 = 0 AS same FROM pairs), s AS (SELECT CAST(unnest(range(0, 41)) AS INTEGER) AS threshold),
c AS (SELECT threshold, CAST(count_if(distance <= threshold AND same) AS BIGINT) AS tp, CAST(count_if(distance > threshold AND same) AS BIGINT) AS fn, CAST(count_if(distance <= threshold AND NOT same) AS BIGINT) AS fp, CAST(count_if(distance > threshold AND NOT same) AS BIGINT) AS tn FROM l, s GROUP BY 1)
SELECT *, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN fn / (tp + fn) END, 6) AS fnr, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END - CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS youden FROM c""")
def threshold_sweep(spark, d):
    s = similarity.threshold_sweep(similarity.distance_counts(adapters.signatures(spark, d), lambda a, b: (a + b) % 3 == 0))
    rates = [F.round(c, 6).alias(c) for c in ("recall", "precision", "fnr", "fpr", "f1", "youden")]
    return s.select("threshold", "tp", "fn", "fp", "tn", *rates)


@query(f"""WITH {PAIRS}, n AS (SELECT unit, a, b FROM pairs WHERE distance <= 20), o AS (SELECT unit, a, b FROM n UNION ALL SELECT unit, b, a FROM n)
SELECT count(*) AS open_triples FROM o x JOIN o y ON x.unit = y.unit AND x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.unit = x.unit AND n.a = x.b AND n.b = y.b)""")
def open_triples(spark, d):
    s = adapters.signatures(spark, d)
    return similarity.open_triples(similarity.close_pairs(s, 20), s, 20)


TWICE = SIGS + ", twice AS (SELECT id, unit, hi, lo FROM sigs UNION ALL SELECT id + 10000000, unit, hi, xor(lo, CAST(1 + id % 7 AS BIGINT)) FROM sigs UNION ALL SELECT id + 20000000, unit, xor(hi, CAST(id % 4096 AS BIGINT)), lo FROM sigs)"


def _thrice(spark, d):
    """Every signature, and two more in which some bits are turned, so that there are groups at every threshold."""
    s = adapters.signatures(spark, d)
    low = s.select((F.col("id") + 10000000).alias("id"), "unit", "hi", F.col("lo").bitwiseXOR((F.lit(1) + F.col("id") % 7).cast("long")).alias("lo"))
    high = s.select((F.col("id") + 20000000).alias("id"), "unit", F.col("hi").bitwiseXOR((F.col("id") % 4096).cast("long")).alias("hi"), "lo")
    return s.select("id", "unit", "hi", "lo").unionByName(low).unionByName(high)


@query(f"""WITH RECURSIVE {TWICE}, near AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM twice a JOIN twice b ON a.unit = b.unit AND a.id < b.id),
e AS (SELECT a, b, t FROM near JOIN (SELECT unnest(range(4, 21, 2)) AS t) ON distance <= t), o AS (SELECT a, b, t FROM e UNION ALL SELECT b, a, t FROM e),
w AS (SELECT id, t, id AS r FROM twice, (SELECT unnest(range(4, 21, 2)) AS t) UNION SELECT o.b, w.t, w.r FROM w JOIN o ON o.a = w.id AND o.t = w.t)
SELECT CAST(t AS INTEGER) AS threshold, unit, id, min(r) AS group_id FROM w JOIN twice USING (id) GROUP BY ALL""")
def groups_at_stops(spark, d):
    """Groups at all nine thresholds offered, from one spanning forest: no pair is computed again."""
    s = _thrice(spark, d)
    forest = similarity.near_forest(s, similarity.MOST)
    out = [similarity.groups_at(forest, s, t).withColumn("threshold", F.lit(t)) for t in range(similarity.LEAST, similarity.MOST + 1, 2)]
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.select("threshold", "unit", "id", "group_id")


@query(f"""WITH {TWICE} SELECT a.unit, a.id AS a, b.id AS b, CAST(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS INTEGER) AS distance FROM twice a JOIN twice b ON a.unit = b.unit AND a.id < b.id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12""")
def hamming_pairs_pivots(spark, d):
    """Pairs within 12 bits, found in small cells around pivots."""
    return similarity.close_pairs(_thrice(spark, d), 12, block=32)


@query(f"WITH RECURSIVE {STRICT} SELECT * FROM strict")
def strict_clusters_parted(spark, d):
    """Strict groups folded over neighbour lists of connected parts, as units of more than a few thousand rows are."""
    return similarity.cluster(adapters.signatures(spark, d), 20, unit_rows=8)


# ---- places

KM = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


@query(f"WITH {SHOTS}, c AS (SELECT unit, avg(lat) AS lat, avg(lon) AS lon FROM shots GROUP BY 1) SELECT a.unit AS a, b.unit AS b, round({KM.format('a.lat', 'b.lat', 'a.lon', 'b.lon')}, 3) AS km FROM c a JOIN c b ON a.unit < b.unit")
def haversine_pairs(spark, d):
    c = adapters.shots(spark, d).groupBy("unit").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return geo.pair_distances(c).select("a", "b", F.round("km", 3).alias("km"))


PLACES = [("north", 10.0, -40.0), ("south", -35.0, 20.0), ("east", -20.0, 100.0), ("west", 30.0, -100.0), ("middle", 0.0, 0.0)]


@query(f"""WITH {SHOTS}, c AS (SELECT unit, min(lat) AS lat, min(lon) AS lon FROM shots WHERE lat IS NOT NULL GROUP BY 1), p(name, plat, plon) AS (VALUES {", ".join(map(str, PLACES))}),
m AS (SELECT unit, name, {KM.format('lat', 'plat', 'lon', 'plon')} AS km FROM c, p) SELECT unit, name, round(km, 3) AS km FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY km, name) AS n FROM m WHERE km <= 2500) WHERE n = 1""")
def nearest_place(spark, d):
    c = adapters.shots(spark, d).where("lat IS NOT NULL").groupBy("unit").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    p = spark.createDataFrame(PLACES, "name string, lat double, lon double")
    return geo.nearest_within(c, p, 2500, ["unit"]).select("unit", "name", F.round("km", 3).alias("km"))


@query(f"""WITH RECURSIVE {SHOTS}, p AS (SELECT unit, lat, lon, row_number() OVER (PARTITION BY unit ORDER BY ts, id) AS i FROM shots WHERE lat IS NOT NULL AND lon IS NOT NULL),
s(unit, i, c) AS (SELECT unit, CAST(0 AS BIGINT), CAST([] AS STRUCT(lat DOUBLE, lon DOUBLE, n BIGINT)[]) FROM p GROUP BY 1 UNION ALL
 SELECT unit, i, CASE WHEN len(d) > 0 AND list_min(d) <= 2.0 THEN list_transform(c, lambda v, k: CASE WHEN k = list_position(d, list_min(d)) THEN {{'lat': (v.lat * v.n + lat) / (v.n + 1), 'lon': (v.lon * v.n + lon) / (v.n + 1), 'n': v.n + 1}} ELSE v END) ELSE list_append(c, {{'lat': lat, 'lon': lon, 'n': CAST(1 AS BIGINT)}}) END
 FROM (SELECT s.unit, p.i, s.c, p.lat, p.lon, list_transform(s.c, lambda v: {KM.format('v.lat', 'p.lat', 'v.lon', 'p.lon')}) AS d FROM s JOIN p ON p.unit = s.unit AND p.i = s.i + 1))
SELECT unit, CAST(k - 1 AS BIGINT) AS cluster, c[k].n AS n, round(c[k].lat, 6) AS lat, round(c[k].lon, 6) AS lon FROM (SELECT unit, c, generate_subscripts(c, 1) AS k FROM s WHERE (unit, i) IN (SELECT unit, max(i) FROM p GROUP BY 1))""")
def location_clusters(spark, d):
    c = geo.leader_centres(adapters.shots(spark, d), 2.0, "unit")
    # rounded in binary, as SQL does: round() of a column goes by the decimal digits
    six = lambda x: (F.round(F.col(x) * 1e6) / 1e6).alias(x)
    return c.select("unit", "cluster", "n", six("lat"), six("lon"))


# ---- passes and ranking

RANKED = "SELECT o_orderkey AS id, c_mktsegment AS unit, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey"


def _judged(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("id"), F.col("c_mktsegment").alias("unit"), F.col("o_totalprice").alias("score"))


@query(f"""WITH o AS ({RANKED}), p AS (SELECT *, (row_number() OVER (PARTITION BY unit ORDER BY id) - 1) // 9 AS page FROM o), q AS (SELECT *, count(*) OVER (PARTITION BY unit, page) AS n, row_number() OVER (PARTITION BY unit, page ORDER BY score DESC, id) AS r FROM p)
SELECT unit, id, page FROM q WHERE r <= greatest(1, n // 2)""")
def page_quota_topq(spark, d):
    paged = staged.pages(_judged(spark, d), "unit", [F.col("id")], 9)
    return staged.keep_per_page(paged, "unit", [F.col("score").desc(), F.col("id")]).where("kept").select("unit", "id", "page")


@query(f"""WITH RECURSIVE o AS ({RANKED}), s(unit, pass_no, before, after, screens) AS (SELECT unit, 0, NULL::BIGINT, count(*), NULL::BIGINT FROM o GROUP BY 1
UNION ALL SELECT unit, pass_no + 1, after, (after // 9) * 4 + CASE WHEN after % 9 > 0 THEN greatest(1, (after % 9) // 2) ELSE 0 END, (after + 8) // 9 FROM s WHERE after > 48 AND pass_no < 9)
SELECT unit, CAST(pass_no AS INTEGER) AS pass_no, before, CAST(after AS BIGINT) AS after, CAST(screens AS BIGINT) AS screens FROM s WHERE pass_no > 0""")
def schedule_projection(spark, d):
    units = _judged(spark, d).groupBy("unit").agg(F.count("*").alias("n")).withColumn("target", F.lit(16))
    return staged.schedule_frame(units)


@query("""WITH p AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS n, greatest(1, least(p_partkey % 20 + 1, p_size)) AS d FROM part) SELECT id, CAST(CASE WHEN n < 2 THEN 0 ELSE floor(greatest(n - 1.0, least((n - 1) + (d - 1) * log2(n), n * (log2(n) - 1))) + 0.5) END AS BIGINT) AS price FROM p""")
def rank_price(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), staged.rank_price(F.col("p_size").cast("long"), F.col("p_partkey") % 20 + 1).alias("price"))


@query("""WITH o AS (SELECT o_custkey AS unit, o_orderkey AS id, o_totalprice AS score FROM orders) SELECT unit, id, place FROM (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY score DESC, id) AS place FROM o) WHERE place <= 5""")
def bracket_topk(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    return ranking.rank_by_score(o, "unit", "id", "score", 5, 7).where("decided").select("unit", "id", "place")


@query(f"WITH o AS ({RANKED}) SELECT unit, id, place FROM (SELECT unit, id, CAST(row_number() OVER (PARTITION BY unit ORDER BY score DESC, id) AS INTEGER) AS place FROM o) WHERE place <= 20")
def top_k(spark, d):
    return ranking.top_k(_judged(spark, d), "unit", [F.col("score").desc(), F.col("id")], 20).select("unit", "id", "place")


@query(f"""WITH RECURSIVE {FOLDERS}, u AS (SELECT array_to_string(string_split(dir, '/')[1:2], '/') AS unit, list(id ORDER BY id) AS a FROM folders GROUP BY 1),
s(unit, a, i, x) AS (SELECT unit, a, CAST(len(a) AS BIGINT), CAST(42 AS BIGINT) FROM u UNION ALL
 SELECT unit, list_transform(a, lambda v, n: CASE WHEN n = i THEN a[y % i + 1] WHEN n = y % i + 1 THEN a[i] ELSE v END), i - 1, y FROM (SELECT *, (x * 1664525 + 1013904223) % 4294967296 AS y FROM s WHERE i > 1))
SELECT unit, unnest(a) AS face, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS pos FROM s WHERE i <= 1""")
def seeded_deal(spark, d):
    c = adapters.customers_in_folders(spark, d).select(F.substring_index("dir", "/", 2).alias("unit"), F.col("id").alias("face"), F.col("id").alias("ord"))
    return staged.shuffle_rows(c, "unit", "face", 42)


@query("""WITH RECURSIVE s(rounds, slots) AS (SELECT CAST(0 AS BIGINT), [1] UNION ALL SELECT rounds + 1, flatten(list_transform(slots, lambda x: [x, 2 * len(slots) + 1 - x])) FROM s WHERE rounds < 7)
SELECT c_custkey AS id, array_to_string(slots, ',') AS slots FROM customer JOIN s ON rounds = c_custkey % 8""")
def seed_slots(spark, d):
    """Seeds in bracket order, for brackets of 1 to 128."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(ranking.seed_slots_expr((F.col("c_custkey") % 8).cast("int")).cast("array<string>"), ",").alias("slots"))


# ---- sets, tags, rates


@query(f"WITH o AS ({RANKED}), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY score DESC, id) AS p, row_number() OVER (PARTITION BY unit ORDER BY score, id) AS q FROM o) SELECT id, min(CASE WHEN p <= 10 THEN 0 ELSE 1 END) AS set_no FROM r WHERE p <= 10 OR q <= 10 GROUP BY 1")
def winner_union(spark, d):
    j = _judged(spark, d)
    best = ranking.top_k(j, "unit", [F.col("score").desc(), F.col("id")], 10).select("id", F.col("place").alias("ord"))
    least = ranking.top_k(j, "unit", [F.col("score"), F.col("id")], 10).select("id", F.col("place").alias("ord"))
    return results.union_first([best, least]).select("id", "set_no")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def tag_sets(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    marked = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return results.intersect_ordered(o, marked)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def cut_except(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return results.except_ordered(o, table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("id")))


@query("SELECT o_orderkey AS id, o_custkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def new_rows_anti(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"))
    return files.new_rows(o, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id")))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def scope_semi(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return files.in_scope(c, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id")))


@query("WITH m AS (SELECT d.source AS class, l.quality FROM documents d JOIN labels l USING (doc_id)) SELECT class, count(*) AS entered, CAST(count_if(quality = 1) AS BIGINT) AS kept, round(count_if(quality = 1) / count(*), 6) AS rate FROM m GROUP BY 1 HAVING count(*) >= 5")
def keep_rate(spark, d):
    m = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return stats.keep_rate(m, F.col("source"), F.col("quality") == 1).withColumn("rate", F.round("rate", 6))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def median_value(spark, d):
    return stats.medians(table(spark, d, "events"), ["event_type"], "value").withColumn("median", F.round("median", 6))


_AT = "CAST(floor((count(*) - 1) * {} + 0.5) AS BIGINT) + 1"


@query("SELECT event_type, count(*) AS n, min(value) AS min, " + ", ".join(f"list_sort(list(value))[{_AT.format(p)}] AS {n}" for n, p in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95))) + ", max(value) AS max, floor(avg(value) * 100 + 0.5) / 100 AS mean FROM events GROUP BY 1")
def nearest_ranks(spark, d):
    return stats.nearest_ranks(table(spark, d, "events"), ["event_type"], "value")


@query("SELECT lang AS tag_id, count(*) AS n FROM documents GROUP BY 1")
def tag_counts(spark, d):
    docs = table(spark, d, "documents")
    names = docs.select(F.col("lang").alias("tag_id")).distinct().select("tag_id", F.col("tag_id").alias("name"), F.lit(0).alias("ord"))
    return tags.counts(names, docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tag_id"))).select("tag_id", "n")


@query("SELECT p_brand AS unit, id, CASE WHEN n > 1 THEN first ELSE id END AS face FROM (SELECT p_brand, p_partkey AS id, count(*) OVER w AS n, min(p_partkey) OVER w AS first FROM part WINDOW w AS (PARTITION BY p_brand, p_type, p_size))")
def group_faces(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("unit"), F.col("p_partkey").alias("id"), F.concat_ws(":", "p_type", "p_size").alias("group_id"))
    return staged.faces(p.select("unit", "id", F.col("id").alias("ord")), p).select("unit", "id", "face")


# ---- text, names, sinks


@query("SELECT page_id AS id, CASE WHEN g <> '' AND regexp_matches(g, '^[=+\\-@]') THEN '\"''' || replace(g, '\"', '\"\"') || '\"' WHEN regexp_matches(g, '[\",]') THEN '\"' || replace(g, '\"', '\"\"') || '\"' ELSE g END AS field FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '=' || url || ',' WHEN 1 THEN url || ', \"x\"' ELSE url END AS g FROM pages)")
def csv_guard(spark, d):
    p = table(spark, d, "pages")
    s = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("="), "url", F.lit(","))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(', "x"'))).otherwise(F.col("url"))
    return p.select(F.col("page_id").alias("id"), text.csv_field(s).alias("field"))


@query("SELECT id, row_number() OVER (ORDER BY n) AS ord FROM (SELECT s_suppkey AS id, CAST(s_suppkey AS BIGINT) * CASE WHEN s_suppkey % 3 = 0 THEN 1626253953123 ELSE 1 END AS n FROM supplier)")
def natural_sort(spark, d):
    """Names with numbers of one to sixteen digits, some padded with zeros."""
    number = F.col("s_suppkey").cast("long") * F.when(F.col("s_suppkey") % 3 == 0, F.lit(1626253953123)).otherwise(F.lit(1))
    padded = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("00"), number.cast("string"))).otherwise(number.cast("string"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("IMG"), padded, F.lit(".jpg")).alias("short"))
    return order.positions(s, None, [text.natural_key(F.col("short")), F.col("id")]).select("id", (F.col("pos") + 1).alias("ord"))


@query("""SELECT id, CASE WHEN NOT x > 0 OR x IS NULL THEN NULL WHEN x <= 23.5 THEN 'Ultra-wide (under 24mm)' WHEN x <= 35.5 THEN 'Wide (24-35mm)' WHEN x <= 70.5 THEN 'Normal (36-70mm)' WHEN x <= 135.5 THEN 'Short tele (71-135mm)' ELSE 'Tele (over 135mm)' END AS band,
 CASE WHEN w = 0 OR h = 0 THEN NULL WHEN w > h * 1.02 THEN 'Landscape' WHEN h > w * 1.02 THEN 'Portrait' ELSE 'Square' END AS orientation
 FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN p_size * 4.0 + CASE WHEN p_size % 2 = 0 THEN 3.5 ELSE 0 END END AS x, CASE WHEN p_partkey % 2 = 0 THEN a ELSE b END AS w, CASE WHEN p_partkey % 2 = 0 THEN b ELSE a END AS h FROM (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 5095 + p_partkey % 9 END AS a, 5000 AS b FROM part))""")
def capture_bands(spark, d):
    """Sides around the edge: 5100 by 5000 is square, 5101 by 5000 is not."""
    p = table(spark, d, "part")
    fl = F.when(F.col("p_partkey") % 7 > 0, F.col("p_size") * 4.0 + F.when(F.col("p_size") % 2 == 0, 3.5).otherwise(0.0))
    a, b, even = F.when(F.col("p_partkey") % 11 == 0, 0).otherwise(5095 + F.col("p_partkey") % 9), F.lit(5000), F.col("p_partkey") % 2 == 0
    return p.select(F.col("p_partkey").alias("id"), capture.focal_band(F.lit(None).cast("double"), fl).alias("band"), capture.orientation(F.when(even, a).otherwise(b), F.when(even, b).otherwise(a)).alias("orientation"))


@query("SELECT page_id AS id, url AS path, regexp_replace(left(regexp_replace(u, '[/:?]', '-', 'g'), 80), '[. ]+$', '') AS segment, regexp_replace(regexp_replace(lower(u), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')[:48] AS slug FROM (SELECT *, url || '?' || repeat('x', CAST(page_id % 50 AS INTEGER)) || '.. ' AS u FROM pages)")
def safe_names(spark, d):
    """Names of up to and over 80 characters, with a dot and space at the end."""
    u = F.concat(F.col("url"), F.lit("?"), F.repeat(F.lit("x"), (F.col("page_id") % 50).cast("int")), F.lit(".. "))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("path"), text.path_segment(u).alias("segment"), text.slug(u).alias("slug"))


#: Extensions as they are written on files, and what they stand for.
EXTENSIONS = {
    "image": {"jpeg": "JPG jpeg jpe", "png": "png", "webp": "webp", "gif": "GIF", "heic": "heic HEIF hif"}, "skipped": {"video": "mp4 MOV m4v avi mkv webm mpg mpeg 3gp wmv", "raw": "CR2 cr3 nef arw dng raf orf rw2 pef srw"}, "unknown": {"unknown": "txt avif tar.gz jpg~"},
}
_EXT = [(e, k, c) for c, kinds in EXTENSIONS.items() for k, names in kinds.items() for e in names.split()]


@query(f"WITH e(n, class, kind) AS (VALUES {', '.join(f'({i}, {chr(39)}{c}{chr(39)}, {chr(39)}{k}{chr(39)})' for i, (_, k, c) in enumerate(_EXT))}) SELECT class, kind, count(*) AS n FROM part JOIN e ON p_partkey % {len(_EXT)} = e.n GROUP BY 1, 2")
def triage_kinds(spark, d):
    ext = F.element_at(F.array(*[F.lit(x) for x, _, _ in _EXT]), (F.col("p_partkey") % len(_EXT) + 1).cast("int"))
    f = files.from_paths(table(spark, d, "part").select(F.concat(F.lit("a/b.jpg/"), F.col("p_name"), F.lit("."), ext).alias("path")))
    return files.triage(f).groupBy("class", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH o AS ({RANKED}) SELECT unit, id, lpad(CAST(r AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS ordinal FROM (SELECT unit, id, row_number() OVER (PARTITION BY unit ORDER BY id) AS r, count(*) OVER (PARTITION BY unit) AS n FROM o)""")
def ranked_ordinals(spark, d):
    return results.ranked(_judged(spark, d).withColumn("ord", F.col("id")), "unit").select("unit", "id", "ordinal")


@query(f"""WITH r AS (SELECT {adapters.RECORD} FROM part) SELECT id, 'out/' || kind AS folder, name AS file, path AS original_path, CASE WHEN id % 4 = 0 THEN 'a; b' WHEN id % 2 = 0 THEN 'b' END AS tags, replace(taken, 'T', ' ') AS taken, tz AS timezone,
 CASE id % 5 WHEN 0 THEN 'Canon EOS R6' WHEN 1 THEN 'NIKON Z 6' WHEN 2 THEN 'Apple iPhone 15 Pro' WHEN 3 THEN 'X100' END AS camera, lens, nullif(fl, 0) AS focal_mm, nullif(fl35, 0) AS focal_35mm, nullif(f, 0) AS aperture, exposure AS shutter_s, nullif(iso, 0) AS iso, lat AS latitude, lon AS longitude,
 CASE WHEN near IS NULL THEN country WHEN country IS NULL OR country = near THEN near ELSE near || ', ' || country END AS place, CAST(nullif(w, 0) AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, kind AS format, CAST(nullif(size, 0) AS DOUBLE) AS bytes, CASE WHEN id % 3 = 0 THEN 'yes' ELSE 'no' END AS copied
 FROM (SELECT *, coalesce(nullif(city, ''), nullif(sublocation, ''), nullif(state, '')) AS near FROM r)""")
def manifest(spark, d):
    rows = adapters.records(spark, d).withColumn("folder", F.concat(F.lit("out/"), "kind"))
    marks = rows.where("id % 4 = 0").select("id", F.lit("t1").alias("tag_id")).union(rows.where("id % 2 = 0").select("id", F.lit("t2")))
    names = spark.createDataFrame([("t1", "a", 1), ("t2", "b", 2)], "tag_id string, name string, ord int")
    m = results.manifest(rows, tags.tag_list(marks, names), rows.where("id % 3 = 0"))
    return m.withColumns({c: F.col(c).cast("double") for c in ("width", "height", "bytes")})


@query("SELECT doc_id AS id, any_value(n_chars) AS n_chars FROM documents GROUP BY 1")
def keyed_upsert(spark, d):
    """Rows of a keyed store after a second write of the same keys."""
    from winnowlane.scratch import fresh_path
    from winnowlane.sources.store import Store

    store = Store(spark, fresh_path(spark, "store"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    store.put("docs", rows.withColumn("n_chars", F.lit(0).cast("long")))
    store.put("docs", rows)
    return store.all("docs")


@query("SELECT p_partkey AS id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(p_name, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h FROM part")
def name_hashes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), signature.fnv1a32(F.col("p_name")).alias("h"))


@query("SELECT p_partkey AS id, p_name || ',' || CASE WHEN p_size IS NULL THEN '' ELSE CAST(p_size AS VARCHAR) END AS line FROM part")
def csv_rows(spark, d):
    p = table(spark, d, "part").withColumn("ord", F.col("p_partkey"))
    return sinks.csv_lines(p, ["p_name", "p_size"]).select(F.col("ord").alias("id"), "line")


from winnowlane import operator_queries  # noqa: E402,F401  (its queries register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _FOUND.items() if s}
