"""The registered queries of the clustering workbench, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardinal.functions import text as T
from cardinal.functions.vectors import cosine_distance
from cardinal.operators import buckets, catalog, centroids, metrics, pairs, prepare, sampling
from cardinal.plans import runner
from cardinal.sources.tables import embeddings, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


#: Shared SQL: the dataset, the class sizes, distances to the first row of each class, and the labels by filled buckets.
ROWS = "r AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS BIGINT) AS y FROM embeddings)"
SIZES = "s AS (SELECT dense_rank() OVER (ORDER BY y) AS cluster, n AS size FROM (SELECT y, count(*) AS n FROM r GROUP BY y))"
MEDOIDS = "m AS (SELECT y + 1 AS cluster, arg_min(x, row_id) AS v FROM r GROUP BY y)"
NEAR = "d AS (SELECT r.row_id, r.y, m.cluster, round(1 - list_cosine_similarity(r.x, m.v), 9) AS d FROM r, m), near AS (SELECT row_id, y, min(d) AS d FROM d GROUP BY row_id, y)"
BOUNDS = "b AS (SELECT cluster, sum(size) OVER (ORDER BY cluster) AS hi, sum(size) OVER (ORDER BY cluster) - size AS lo FROM s)"
FILLED = "c AS (SELECT q.row_id, q.y, b.cluster FROM (SELECT *, row_number() OVER (ORDER BY d, row_id) AS rn FROM near) q JOIN b ON q.rn > b.lo AND q.rn <= b.hi)"
LABELLED = f"WITH {ROWS}, {SIZES}, {MEDOIDS}, {NEAR}, {BOUNDS}, {FILLED}"
TABLE_ = "t AS (SELECT y, cluster, count(*) AS n FROM c GROUP BY ALL), ra AS (SELECT y, sum(n) AS a FROM t GROUP BY y), cb AS (SELECT cluster, sum(n) AS b FROM t GROUP BY cluster), tot AS (SELECT sum(n) AS n FROM t)"
INFORMATION = (
    "inf AS (SELECT (SELECT -sum(a / tot.n * ln(a / tot.n)) FROM ra, tot) AS ha, (SELECT -sum(b / tot.n * ln(b / tot.n)) FROM cb, tot) AS hb, "
    "(SELECT sum(t.n / tot.n * ln(t.n * tot.n / (a * b))) FROM t JOIN ra USING (y) JOIN cb USING (cluster), tot) AS mi)"
)

PAIRED = "z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS s, (SELECT sum(a * (a - 1) / 2) FROM ra) AS sa, (SELECT sum(b * (b - 1) / 2) FROM cb) AS sb, n FROM tot)"
ARI_SQL = "round((s - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2)), 9)"
EXPECTED = (
    "o AS (SELECT a, b, tot.n AS n, unnest(range(CAST(greatest(1, a + b - tot.n) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS o FROM ra, cb, tot), "
    "emi AS (SELECT sum(o / n * ln(n * o / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(o + 1) - lgamma(a - o + 1) - lgamma(b - o + 1) - lgamma(n - a - b + o + 1))) AS e FROM o)"
)
SILHOUETTES = (
    "g AS (SELECT a.row_id, a.cluster, b.cluster AS other, avg(1 - list_cosine_similarity(a.x, b.x)) AS d FROM l a JOIN l b ON a.row_id <> b.row_id GROUP BY ALL), "
    "ab AS (SELECT row_id, cluster, min(d) FILTER (WHERE other = cluster) AS a, min(d) FILTER (WHERE other <> cluster) AS b FROM g GROUP BY ALL)"
)


def sizes_of(rows: DataFrame) -> DataFrame:
    """(cluster, size): classes in order, numbered from 1."""
    return prepare.level_codes(prepare.class_sizes(rows), "y", "cluster").select("cluster", F.col("n").alias("size"))


def first_rows(rows: DataFrame) -> DataFrame:
    """(cluster, centroid): the first row of each class as its medoid."""
    return rows.groupBy("y").agg(F.min_by("x", "row_id").alias("centroid")).select((F.col("y") + 1).alias("cluster"), "centroid")


def to_medoids(rows: DataFrame, but: int = 0) -> DataFrame:
    """(row_id, y, cluster, d) of the nearest medoid, that of cluster `but` left out."""
    return centroids.nearest(rows, first_rows(rows).where(F.col("cluster") != but), digits=9).drop("x")


def filled(rows: DataFrame) -> DataFrame:
    """(row_id, y, cluster, d): rows by their distance to the nearest medoid fill the clusters."""
    return buckets.fill(to_medoids(rows).drop("cluster"), sizes_of(rows), F.col("d"), F.col("row_id"))


@query("SELECT CAST(label AS BIGINT) AS y, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.class_sizes(embeddings(spark, sf_dir))


@query("SELECT string_agg(y || ':' || n, '; ' ORDER BY y) AS class_distribution FROM (SELECT o_orderpriority AS y, count(*) AS n FROM orders GROUP BY 1)")
def class_distribution_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = prepare.class_sizes(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "y"))
    return sizes.agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("c")).select(T.class_text(F.col("c.y"), F.col("c.n")).alias("class_distribution"))


@query("SELECT string_agg(CAST(n AS VARCHAR), '-' ORDER BY n) AS class_dist_signature FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)")
def class_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.class_sizes(embeddings(spark, sf_dir)).agg(F.collect_list("n").alias("v")).select(T.signature(F.col("v")).alias("class_dist_signature"))


#: name, target column, number of features that are strings.
_PROFILED = (("customer", "c_mktsegment", 1), ("documents", "lang", 2), ("embeddings", "label", 0), ("events", "event_type", 1), ("labels", "quality", 0), ("lineitem", "l_returnflag", 1), ("orders", "o_orderstatus", 1), ("part", "p_type", 2))


@query(" UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS \"NumberOfInstances\", count(DISTINCT {target}) AS \"NumberOfClasses\", CAST({symbolic} AS BIGINT) AS \"NumberOfSymbolicFeatures\", CAST(sum(CASE WHEN {target} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS \"NumberOfMissingValues\" FROM {name}"
    for name, target, symbolic in _PROFILED
))
def catalog_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = []
    for name, target, _ in _PROFILED:
        df = table(spark, sf_dir, name)
        symbolic = sum(t == "string" for c, t in df.dtypes if c != target)
        found.append(df.agg(F.count("*").alias("NumberOfInstances"), F.count_distinct(target).alias("NumberOfClasses"), F.sum(F.col(target).isNull().cast("bigint")).alias("NumberOfMissingValues")).select(F.lit(name).alias("name"), "NumberOfInstances", "NumberOfClasses", F.lit(symbolic).cast("bigint").alias("NumberOfSymbolicFeatures"), "NumberOfMissingValues"))
    return prepare.union_all(found)


#: The part table read as a catalog.
CATALOG = 'k AS (SELECT p_partkey AS ord, p_name || \' \' || CAST(p_partkey % 40 AS VARCHAR) AS name, p_size % 5 AS "NumberOfClasses", p_partkey % 211 AS "NumberOfInstances", p_partkey % 3 AS "NumberOfSymbolicFeatures", CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 2 END AS "NumberOfMissingValues" FROM part)'


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("ord"), F.concat_ws(" ", "p_name", (key % 40).cast("string")).alias("name"), (F.col("p_size") % 5).alias("NumberOfClasses"), (key % 211).alias("NumberOfInstances"),
        (key % 3).alias("NumberOfSymbolicFeatures"), F.when(key % 7 != 0, key % 2).alias("NumberOfMissingValues"),
    )


@query(
    f'WITH {CATALOG}, a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY "NumberOfClasses", "NumberOfInstances" ORDER BY ord) = 1), '
    "b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY ord) = 1) "
    'SELECT * FROM b WHERE "NumberOfSymbolicFeatures" <= 1 AND "NumberOfMissingValues" = 0'
)
def catalog_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dedup_catalog(part_catalog(spark, sf_dir))


@query(f'WITH {CATALOG} SELECT * FROM k WHERE "NumberOfClasses" BETWEEN 2 AND 3 AND "NumberOfInstances" BETWEEN 50 AND 150 AND "NumberOfSymbolicFeatures" <= 1 AND "NumberOfMissingValues" = 0')
def catalog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranged = part_catalog(spark, sf_dir).where(F.col("NumberOfClasses").between(2, 3) & F.col("NumberOfInstances").between(50, 150))
    return catalog.complete_rows(ranged)


@query(f'WITH {CATALOG}, g AS (SELECT *, CAST("NumberOfClasses" AS VARCHAR) || \'-\' || CAST("NumberOfInstances" % 4 AS VARCHAR) AS class_dist_signature FROM k) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY "NumberOfClasses", "NumberOfInstances", class_dist_signature ORDER BY ord) = 1')
def catalog_dedup_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = part_catalog(spark, sf_dir).withColumn("class_dist_signature", F.concat_ws("-", F.col("NumberOfClasses").cast("string"), (F.col("NumberOfInstances") % 4).cast("string")))
    return catalog.dedup_signatures(signed)


@query(
    "SELECT p_name AS query, p_partkey AS data_id FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY (p_type = 'ECONOMY') DESC, p_size DESC, p_partkey) = 1"
)
def resolve_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.select(F.col("p_partkey").alias("data_id"), F.col("p_name").alias("name"), F.when(F.col("p_type") == "ECONOMY", "active").otherwise("other").alias("status"), F.col("p_size").alias("version"))
    return catalog.resolve(part.select(F.col("p_name").alias("query")).distinct(), known)


@query("SELECT s_suppkey, regexp_replace(regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM supplier")
def slugify_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.slugify(F.col("s_name")).alias("slug"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name || ' - ' || p_brand || '_x')), '[\\s_\\-]+', '', 'g') AS key FROM part")
def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_key(F.concat(F.col("p_name"), F.lit(" - "), F.col("p_brand"), F.lit("_x"))).alias("key"))


_ALIAS_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in T.ALIASES.items())
_NAMES = ("cifar-10", "CIFAR 100", "moda_mnist", "unknown")


@query(
    f"WITH a(k, v) AS (VALUES {_ALIAS_ROWS}), q AS (SELECT n_nationkey, (ARRAY{list(_NAMES)!r})[n_nationkey % 4 + 1] AS name FROM nation) "
    "SELECT n_nationkey, name, coalesce(v, name) AS resolved FROM q LEFT JOIN a ON a.k = regexp_replace(lower(trim(name)), '[\\s_\\-]+', '', 'g')"
)
def alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), F.col("n_nationkey") % 4 + 1)
    return table(spark, sf_dir, "nation").select("n_nationkey", name.alias("name"), T.resolve_alias(name).alias("resolved"))


@query(
    "SELECT l_orderkey, l_linenumber, CAST(l_partkey AS DOUBLE) AS l_partkey, l_quantity, CAST(dense_rank() OVER (ORDER BY l_returnflag) AS DOUBLE) AS l_returnflag, "
    "CAST(dense_rank() OVER (ORDER BY l_linestatus) AS DOUBLE) AS l_linestatus FROM lineitem"
)
def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]
    return prepare.numeric_features(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns), columns)


@query("SELECT o_orderkey, o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) AS code FROM orders")
def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.level_codes(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")


@query(
    "SELECT 'c_nationkey' AS \"column\", count(DISTINCT c_nationkey) AS n_distinct FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer"
)
def drop_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").withColumn("constant", F.lit(1))
    return prepare.column_variety(df, ["c_nationkey", "c_mktsegment", "c_acctbal", "constant"]).where("n_distinct > 1")


def _quota_sql(n: int) -> str:
    return (
        f"q0 AS (SELECT o_orderpriority AS stratum, count(*) AS size FROM orders GROUP BY 1), q1 AS (SELECT *, sum(size) OVER () AS total, count(*) OVER () AS classes FROM q0), "
        f"q2 AS (SELECT *, CAST(size - 1 AS DOUBLE) / (total - classes) * ({n} - classes) AS desired FROM q1), q3 AS (SELECT *, least(floor(desired), size - 1) AS base, desired - floor(desired) AS fraction FROM q2), "
        f"q4 AS (SELECT *, ({n} - classes) - sum(base) OVER () AS short, row_number() OVER (ORDER BY fraction DESC, stratum) AS place FROM q3), "
        f"q AS (SELECT stratum, size, CAST(CASE WHEN {n} >= total THEN size ELSE 1 + base + CASE WHEN place <= short THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM q4)"
    )


KEY_SQL = "((o_orderkey * 1103515245 + 42) % 2147483647)"


@query(f"WITH {_quota_sql(500)} SELECT * FROM q")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(table(spark, sf_dir, "orders"), "o_orderpriority", 500)


@query(
    f"WITH {_quota_sql(500)} SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {KEY_SQL}, o_orderkey) AS place FROM orders) o JOIN q ON o.o_orderpriority = q.stratum WHERE place <= quota"
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 500, 42).select("o_orderkey", "o_orderpriority")


@query(f"SELECT o_orderkey, o_orderpriority FROM orders ORDER BY {KEY_SQL}, o_orderkey LIMIT 500")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 500, 42)


@query(f"WITH {ROWS}, {MEDOIDS} SELECT r.row_id, m.cluster, round(1 - list_cosine_similarity(r.x, m.v), 6) AS d FROM r, m")
def cosine_to_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return centroids.distances(rows, first_rows(rows), digits=6).select("row_id", "cluster", "d")


@query(f"WITH {ROWS} SELECT a.row_id AS i, b.row_id AS j, round(1 - list_cosine_similarity(a.x, b.x), 6) AS d FROM r a JOIN r b ON a.row_id < b.row_id")
def pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cosine_pairs(embeddings(spark, sf_dir), digits=6)


@query(f"WITH {ROWS}, {MEDOIDS}, {NEAR} SELECT row_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM d GROUP BY row_id")
def nearest_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_medoids(embeddings(spark, sf_dir)).drop("y")


@query(
    f"WITH {ROWS}, {SIZES}, {BOUNDS} SELECT q.row_id, b.cluster FROM (SELECT row_id, row_number() OVER (ORDER BY round(x[1], 6), row_id) AS rn FROM r) q JOIN b ON q.rn > b.lo AND q.rn <= b.hi"
)
def cardinality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    keyed = rows.select("row_id", F.round(F.col("x")[0], 6).alias("key"))
    return buckets.fill(keyed, sizes_of(rows), F.col("key"), F.col("row_id")).select("row_id", "cluster")


@query(f"WITH {ROWS}, {SIZES}, {BOUNDS} SELECT q.row_id, b.cluster FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) AS rn FROM r) q JOIN b ON q.rn > b.lo AND q.rn <= b.hi")
def row_block_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return buckets.fill(rows.select("row_id"), sizes_of(rows), F.col("row_id")).select("row_id", "cluster")


@query(f"{LABELLED} SELECT row_id, cluster FROM c")
def kmedoids_sc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(embeddings(spark, sf_dir)).select("row_id", "cluster")


PARTICLES = 3
PARTICLE_SQL = f"p AS (SELECT particle_id, row_id, x, (row_id * 1103515245 + particle_id * 12345) % 2147483647 AS par FROM r, range({PARTICLES}) g(particle_id))"
DECODED_SQL = f"WITH {ROWS}, {SIZES}, {BOUNDS}, {PARTICLE_SQL}, c AS (SELECT q.particle_id, q.row_id, q.x, b.cluster FROM (SELECT *, row_number() OVER (PARTITION BY particle_id ORDER BY par, row_id) AS rn FROM p) q JOIN b ON q.rn > b.lo AND q.rn <= b.hi)"


def decoded(rows: DataFrame) -> DataFrame:
    swarm = rows.withColumn("particle_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTICLES - 1).cast("bigint"))))
    keyed = swarm.withColumn("par", F.pmod(F.col("row_id") * 1103515245 + F.col("particle_id") * 12345, F.lit(2147483647)))
    return buckets.fill_groups(keyed, sizes_of(rows), ["particle_id"], F.col("par"), F.col("row_id"))


@query(f"{DECODED_SQL} SELECT particle_id, row_id, cluster FROM c")
def random_key_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(embeddings(spark, sf_dir)).select("particle_id", "row_id", "cluster")


@query(f"WITH {ROWS} SELECT a.y + 1 AS cluster, round(sum(1 - list_cosine_similarity(a.x, b.x)), 4) AS cost FROM r a JOIN r b ON a.y = b.y AND a.row_id < b.row_id GROUP BY a.y")
def within_cluster_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("cluster", F.col("y") + 1)
    return pairs.within_cost(rows).withColumn("cost", F.round("cost", 4))


UNNESTED = "u AS (SELECT row_id, y + 1 AS cluster, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM r)"


@query(f"WITH {ROWS}, {UNNESTED} SELECT cluster, pos, round(avg(v), 6) AS mean FROM u GROUP BY ALL")
def centroids_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("cluster", F.col("y") + 1)
    return centroids.long_means(rows).select("cluster", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


@query(
    f"WITH {ROWS}, {UNNESTED}, g AS (SELECT cluster, pos, avg(v) AS mean FROM u WHERE cluster <> 3 GROUP BY ALL), a AS (SELECT pos, avg(v) AS spare FROM u WHERE cluster <> 3 GROUP BY pos), k AS (SELECT DISTINCT cluster FROM u) "
    "SELECT k.cluster, a.pos, round(coalesce(g.mean, a.spare), 6) AS mean FROM k CROSS JOIN a LEFT JOIN g ON g.cluster = k.cluster AND g.pos = a.pos"
)
def global_fill_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("cluster", F.col("y") + 1)
    return centroids.filled_means(rows.where("cluster != 3"), rows.select("cluster").distinct()).select("cluster", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


@query(
    f"WITH {ROWS}, {UNNESTED}, g AS (SELECT cluster, list(mean ORDER BY pos) AS v FROM (SELECT cluster, pos, avg(v) AS mean FROM u GROUP BY ALL) GROUP BY cluster), "
    "e AS (SELECT r.row_id, r.y + 1 AS own, g.cluster, list_distance(r.x, g.v) AS d FROM r, g), ab AS (SELECT row_id, min(d) FILTER (WHERE cluster = own) AS a, min(d) FILTER (WHERE cluster <> own) AS b FROM e GROUP BY row_id) "
    "SELECT row_id, round((b - a) / greatest(a, b), 6) AS s FROM ab"
)
def simplified_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir).withColumn("own", F.col("y") + 1)
    return centroids.simplified_silhouette(rows, centroids.means(rows, "own").withColumnRenamed("own", "cluster")).withColumn("s", F.round("s", 6))


@query(f"{LABELLED} SELECT y, cluster, count(*) AS n FROM c GROUP BY ALL")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.contingency(filled(embeddings(spark, sf_dir)))


@query(
    f"{LABELLED}, {TABLE_}, {PAIRED} "
    f"SELECT {ARI_SQL} AS ari FROM z"
)
def ari(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ari(filled(embeddings(spark, sf_dir))).withColumn("ari", F.round("ari", 9))


@query(f"{LABELLED}, {TABLE_}, {INFORMATION} SELECT round(mi / greatest(ha, hb), 9) AS nmi FROM inf")
def nmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nmi(filled(embeddings(spark, sf_dir))).withColumn("nmi", F.round("nmi", 9))


@query(
    f"{LABELLED}, {TABLE_}, {INFORMATION}, {EXPECTED} "
    "SELECT round((mi - e) / (greatest(ha, hb) - e), 6) AS ami FROM inf, emi"
)
def ami(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ami(filled(embeddings(spark, sf_dir))).withColumn("ami", F.round("ami", 6))


@query(
    f"{LABELLED}, l AS (SELECT c.row_id, c.cluster, r.x FROM c JOIN r USING (row_id)), {SILHOUETTES} "
    "SELECT row_id, cluster, round((b - a) / greatest(a, b), 6) AS s FROM ab"
)
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    labelled = filled(rows).select("row_id", "cluster").join(rows.select("row_id", "x"), "row_id")
    return pairs.silhouette(labelled).withColumn("s", F.round("s", 6))


@query(
    f"WITH {ROWS}, {SIZES}, {MEDOIDS}, {NEAR}, a AS (SELECT arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY row_id), n AS (SELECT s.cluster, s.size, count(a.cluster) AS n FROM s LEFT JOIN a USING (cluster) GROUP BY ALL) "
    "SELECT CAST(sum(abs(n - size)) AS BIGINT) AS deviation, CAST(sum(abs(n - size)) * 100 AS DOUBLE) AS penalty FROM n"
)
def size_deviation_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return buckets.size_penalty(to_medoids(rows), sizes_of(rows), 100)


@query(f"WITH {ROWS}, {SIZES}, {MEDOIDS}, {NEAR}, a AS (SELECT arg_min(cluster, (d, cluster)) AS cluster FROM d WHERE cluster <> 2 GROUP BY row_id) SELECT s.cluster, count(a.cluster) AS n FROM s LEFT JOIN a USING (cluster) GROUP BY s.cluster")
def cluster_sizes_with_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    return buckets.cluster_sizes(to_medoids(rows, but=2), sizes_of(rows).select("cluster"))


#: Two clusters: even and odd labels.
TWO = "r2 AS (SELECT row_id, x, y % 2 AS y FROM r), m2 AS (SELECT y, arg_min(x, row_id) AS v FROM r2 GROUP BY y), k2 AS (SELECT r2.row_id, r2.y, round((1 - list_cosine_similarity(x, (SELECT v FROM m2 WHERE y = 0))) - (1 - list_cosine_similarity(x, (SELECT v FROM m2 WHERE y = 1))), 9) AS gain FROM r2)"


def two_costs(rows: DataFrame) -> DataFrame:
    """(row_id, y, gain): cost of the first less that of the second of two clusters."""
    two = rows.withColumn("y", F.col("y") % 2)
    points = two.groupBy("y").agg(F.min_by("x", "row_id").alias("v"))
    one = points.agg(F.max_by("v", -F.col("y")).alias("v0"), F.max_by("v", "y").alias("v1"))  # one row
    gain = cosine_distance(F.col("x"), F.col("v0")) - cosine_distance(F.col("x"), F.col("v1"))
    return two.crossJoin(F.broadcast(one)).select("row_id", "y", F.round(gain, 9).alias("gain"))


@query(f"WITH {ROWS}, {TWO} SELECT row_id, CAST(CASE WHEN row_number() OVER (ORDER BY gain, row_id) <= (SELECT count(*) FROM r2 WHERE y = 0) THEN 1 ELSE 2 END AS BIGINT) AS cluster FROM k2")
def assign_two_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact assignment for two clusters: the rows that gain most go to the first."""
    costs = two_costs(embeddings(spark, sf_dir))
    sizes = costs.groupBy((F.col("y") + 1).alias("cluster")).agg(F.count("*").alias("size"))
    return buckets.fill(costs, sizes, F.col("gain"), F.col("row_id")).select("row_id", "cluster")


@query(
    f"WITH {ROWS}, {TWO}, a AS (SELECT row_id, y, CASE WHEN gain <= 0 THEN 1 ELSE 2 END AS c FROM k2), w AS (SELECT count(*) FILTER (WHERE c = 1) - count(*) FILTER (WHERE y = 0) AS over1 FROM a), "
    "o AS (SELECT row_id, c, row_number() OVER (PARTITION BY c ORDER BY row_id) AS rn FROM a) SELECT row_id, CAST(CASE WHEN c = 1 AND rn <= over1 THEN 2 WHEN c = 2 AND rn <= -over1 THEN 1 ELSE c END AS BIGINT) AS cluster FROM o, w"
)
def adjust_cardinality_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size repair for two clusters: the overfull one gives its lowest rows."""
    from cardinal.functions.ranking import global_rank

    costs = two_costs(embeddings(spark, sf_dir)).withColumn("c", F.when(F.col("gain") <= 0, 1).otherwise(2))
    over = costs.agg((F.sum((F.col("c") == 1).cast("bigint")) - F.sum((F.col("y") == 0).cast("bigint"))).alias("over"))
    first, second = (global_rank(costs.where(F.col("c") == k), F.col("row_id")) for k in (1, 2))
    met = first.unionByName(second).crossJoin(F.broadcast(over))  # one row
    cluster = F.when((F.col("c") == 1) & (F.col("rn") <= F.col("over")), 2).when((F.col("c") == 2) & (F.col("rn") <= -F.col("over")), 1).otherwise(F.col("c"))
    return met.select("row_id", cluster.cast("bigint").alias("cluster"))


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as one dataset in the form that the runner takes."""
    return embeddings(spark, sf_dir).select(F.lit(0).cast("bigint").alias("data_id"), F.lit("embeddings").alias("name"), "row_id", "x", (F.col("y") + 1).alias("y_code"))


def _algorithm(name: str, **parameters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return runner.run(dataset(spark, sf_dir), [name], {name: parameters}).drop("Execution_Time")

    return run


QUERIES |= {
    "csclp": _algorithm("CSCLP"),
    "km_milp": _algorithm("KM-MILP"),
    "sck1": _algorithm("SCK1"),
    "kmedoids_run": _algorithm("KMEDOIDS"),
    "pso": _algorithm("PSO"),
    "bat": _algorithm("BAT"),
}


@query(
    f"WITH {ROWS}, {SIZES}, {BOUNDS}, c AS (SELECT q.row_id, q.y, b.cluster FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM r) q JOIN b ON q.rn > b.lo AND q.rn <= b.hi), "
    f"{TABLE_}, {INFORMATION}, {EXPECTED}, {PAIRED}, l AS (SELECT c.row_id, c.cluster, r.x FROM c JOIN r USING (row_id)), {SILHOUETTES}, "
    "lists AS (SELECT count(*) AS n, count(DISTINCT cluster) AS k, string_agg(CAST(cluster AS VARCHAR), ' ' ORDER BY row_id) AS y_predict, string_agg(CAST(y + 1 AS VARCHAR), ' ' ORDER BY row_id) AS y_true FROM c), "
    "target AS (SELECT string_agg(CAST(size AS VARCHAR), ' ' ORDER BY cluster) AS target_cardinality FROM s), "
    "made AS (SELECT string_agg(CAST(b AS VARCHAR), ' ' ORDER BY cluster) AS cardinality_pred FROM cb) "
    "SELECT 'HCAKC' AS algorithm, CAST(0 AS BIGINT) AS data_id, 'embeddings' AS name, lists.n, k, y_predict, y_true, target_cardinality, cardinality_pred, "
    f"(SELECT {ARI_SQL} FROM z) AS \"ARI\", (SELECT round((mi - e) / (greatest(ha, hb) - e), 6) FROM inf, emi) AS \"AMI\", (SELECT round(mi / greatest(ha, hb), 9) FROM inf) AS \"NMI\", "
    "(SELECT round(avg((b - a) / greatest(a, b)), 6) FROM ab) AS \"Silhouette_mean\" FROM lists, target, made"
)
def hcakc_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The positional baseline's result row, scores rounded."""
    digits = {"ARI": 9, "AMI": 6, "NMI": 9, "Silhouette_mean": 6}
    return _algorithm("HCAKC")(spark, sf_dir).drop("hyperparams", "error").withColumns({c: F.round(c, d) for c, d in digits.items()})


@query()
def assign_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: whether sizes are met and no cycle of moves lowers the cost, and the cost, of the exact assignment to the first rows of the classes."""
    import numpy as np
    import pandas as pd

    from cardinal.operators import kernels as K

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        x, y = np.stack(pdf.x.to_numpy()), pdf.y_code.to_numpy() - 1
        firsts = np.array([np.flatnonzero(y == k)[0] for k in range(y.max() + 1)])
        cost = K.cosine_matrix(x, x[firsts])
        label = K.assign_exact(cost, np.bincount(y))
        return pd.DataFrame({"data_id": [0], "exact_sizes": [bool((np.bincount(label) == np.bincount(y)).all())], "optimal": [K.certificate(cost, label)], "cost": [float(cost[np.arange(len(x)), label].sum())]})

    return dataset(spark, sf_dir).groupBy("data_id").applyInPandas(solve, "data_id bigint, exact_sizes boolean, optimal boolean, cost double")


@query()
def adjust_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(data_id, row_id, cluster): k-means labels with their sizes repaired."""
    import numpy as np
    import pandas as pd

    from cardinal.plans.algorithms import start

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        label = start(np.stack(pdf.x.to_numpy()), np.bincount(pdf.y_code.to_numpy() - 1), np.random.default_rng(1521))
        return pd.DataFrame({"data_id": pdf.data_id, "row_id": pdf.row_id, "cluster": label + 1})

    return dataset(spark, sf_dir).groupBy("data_id").applyInPandas(solve, "data_id bigint, row_id bigint, cluster bigint")


@query()
def aco_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.aco_restarts(embeddings(spark, sf_dir))


#: Scores by class of each language and source stand in for benchmark results.
SCORES_SQL = "v AS (SELECT lang AS algorithm, source AS name, avg(n_chars % 100 / 100.0) AS \"ARI\", avg(n_chars % 37 / 37.0) AS \"AMI\", avg(n_chars % 11 / 11.0) AS \"NMI\" FROM documents GROUP BY ALL)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("algorithm"), F.col("source").alias("name"), (n % 100 / 100).alias("ARI"), (n % 37 / 37).alias("AMI"), (n % 11 / 11).alias("NMI"), (n % 100 / 100).alias("Silhouette_mean"))


@query(f"WITH {SCORES_SQL} SELECT algorithm, name, metric, round(value, 6) AS value FROM (UNPIVOT v ON \"ARI\", \"AMI\", \"NMI\" INTO NAME metric VALUE value)")
def metrics_report_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.report(_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("SELECT lang AS algorithm, round(avg(n_chars % 100 / 100.0), 6) AS value FROM documents GROUP BY 1")
def score_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.ranking(_scores(spark, sf_dir)).withColumn("value", F.round("value", 6))
