"""Queries of operators that check, schedule and convert, with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import arrays, bins, hashes, numbers, text
from tickloom.operators import coverage, islands, joins, projections, sets, summary, ticks, vectors
from tickloom.plans import commit, splits
from tickloom.plans.queries import T, _ticks, query
from tickloom.sources import files
from tickloom.sources.tables import table
from tickloom.streaming import health

# Summaries


@query(
    """WITH p AS (SELECT o_custkey AS session, o_orderkey AS player, CAST(o_orderkey % 5 AS INTEGER) - 1 AS placement, CASE o_orderkey % 7 WHEN 0 THEN 'no-contest' WHEN 1 THEN 'unresolved' ELSE 'game' END AS ending FROM orders),
    w AS (SELECT session, arg_min(player, (placement, player)) AS winner FROM p WHERE placement >= 0 AND ending = 'game' GROUP BY session)
    SELECT session, winner FROM (SELECT DISTINCT session FROM p) LEFT JOIN w USING (session)"""
)
def placement_winners(spark, d):
    k = F.col("o_orderkey")
    ending = F.when(k % 7 == 0, "no-contest").when(k % 7 == 1, "unresolved").otherwise("game")
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("session"), k.alias("player"), ((k % 5).cast("int") - 1).alias("placement"), ending.alias("ending"))
    return summary.placed_winner(own)


@query("SELECT count(*) AS files, CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS bytes FROM pages WHERE url LIKE '%/%' AND NOT url LIKE '%/a%'")
def tree_totals(spark, d):
    return summary.tree(table(spark, d, "pages").select("url", F.length("html").alias("length")), "url", allow=["*/*"], ignore=["*/a*"])


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE l_tax END AS seconds, CAST(l_quantity AS BIGINT) AS row_count, CAST(l_quantity AS BIGINT) * 132 + CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS binary_bytes,
      l_linenumber % 4 AS skipped, l_linenumber AS frames FROM lineitem),
    e AS (SELECT l_orderkey, count(*) FILTER (seconds IS NULL) AS a, count(*) FILTER (seconds > 0.05) AS b, count(*) FILTER (binary_bytes <> row_count * 132) AS c, count(*) FILTER (skipped <> 0) AS s FROM f GROUP BY l_orderkey)
    SELECT l_orderkey, a AS no_timing, b AS too_slow, c AS size_mismatch, s AS skipped_rows FROM e"""
)
def file_rule_counts(spark, d):
    k = F.col("l_partkey")
    rows = F.col("l_quantity").cast("long")
    own = table(spark, d, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_suppkey") % 11 != 0, F.col("l_tax")).alias("seconds"),
        rows.alias("row_count"),
        F.col("l_linenumber").alias("frame_entries"),
        (rows * 132 + F.when(k % 13 == 0, 1).otherwise(0)).alias("binary_bytes"),
        F.lit(132).alias("record_bytes"),
        (F.col("l_linenumber") % 4).alias("skipped_rows"),
        rows.alias("complete_rows"),
        rows.alias("last_frame"),
        F.lit(None).cast("long").alias("metadata_last_frame"),
    )
    found = summary.violations(own, summary.file_rules(0.05))
    has = lambda name: F.count_if(F.array_contains("errors", name)).alias(name.replace("-", "_"))
    return found.groupBy("l_orderkey").agg(*[has(n) for n in ("no-timing", "too-slow", "size-mismatch", "skipped-rows")])


@query(
    """WITH r AS (SELECT o_custkey AS report, count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS failures, max(o_totalprice) / 100000.0::DOUBLE AS slowest, min(o_orderkey % 3) AS record FROM orders GROUP BY 1)
    SELECT report, concat_ws(',', CASE WHEN failures <> 0 THEN 'failures' END, CASE WHEN runs < 5 THEN 'run-count' END, CASE WHEN slowest > 1 THEN 'runs-over-limit' END, CASE WHEN record <> 0 THEN 'unknown-record-size' END) AS errors FROM r"""
)
def report_rules(spark, d):
    own = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("report")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("failures"), (F.max("o_totalprice") / 100000.0).alias("slowest"), (F.min(F.col("o_orderkey") % 3) + 132).alias("record_bytes")
    )
    found = summary.violations(own, summary.report_rules(least_runs=5, max_seconds=1.0, record_bytes=132), ordered=True)
    return found.select("report", F.array_join("errors", ",").alias("errors"))


_OFF = f"""WITH {T}, g AS (SELECT session, idx, x - 60 AS px, mask - 30.0::DOUBLE AS py, mask % 17 = 0 AS dead FROM t),
    o AS (SELECT *, NOT dead AND (abs(px) > 110 OR py > 80 OR py < -25) AS off_screen FROM g)"""


@query(_OFF + " SELECT session, count(*) AS ticks, count(*) FILTER (NOT dead) AS alive, count(*) FILTER (off_screen) AS offscreen, round(count(*) FILTER (off_screen) / greatest(1, count(*) FILTER (NOT dead))::DOUBLE, 6) AS share FROM o GROUP BY session")
def offscreen_audit(spark, d):
    g = _ticks(spark, d).select("session", "idx", (F.col("x") - 60).alias("px"), (F.col("mask") - 30.0).alias("py"), (F.col("mask") % 17 == 0).alias("dead"))
    out = coverage.offscreen_audit(g, "px", "py", "dead", "session")
    return out.withColumn("share", F.round("share", 6))


@query(
    _OFF
    + """, p AS (SELECT session // 2 AS pair, idx, bool_or(off_screen) FILTER (session % 2 = 0) AS a, bool_or(off_screen) FILTER (session % 2 = 1) AS b FROM o GROUP BY ALL HAVING count(DISTINCT session % 2) = 2)
    SELECT CASE WHEN a AND b THEN 'both-offscreen' WHEN a THEN 'first-only-offscreen' WHEN b THEN 'second-only-offscreen' ELSE 'none' END AS configuration, count(*) AS n FROM p GROUP BY 1"""
)
def offscreen_configurations(spark, d):
    g = _ticks(spark, d).select(
        F.floor(F.col("session") / 2).alias("pair"), (F.col("session") % 2).alias("slot"), "idx", bins.offscreen(F.col("x") - 60, F.col("mask") - 30.0, F.col("mask") % 17 == 0).alias("off")
    )
    both = joins.ordered_pairs(g, ["pair", "idx"], "slot", ["off"])
    return coverage.counts(both.select(bins.pair_configuration(F.col("off_0"), F.col("off_1"), "offscreen", "none").alias("configuration")), "configuration")


# Numbers and text


@query(f"WITH {T} SELECT session, idx, round(CASE WHEN x > 0 AND mask > 0 THEN x / mask END, 6) AS per_mask, round(x / 1048576.0::DOUBLE, 9) AS mib, round(mask / greatest(1.0::DOUBLE, x), 6) AS share FROM t")
def unit_conversions(spark, d):
    own = _ticks(spark, d)
    rate = F.when((F.col("x") > 0) & (F.col("mask") > 0), numbers.rate("x", "mask"))
    return own.select("session", "idx", F.round(rate, 6).alias("per_mask"), F.round(numbers.mib("x"), 9).alias("mib"), F.round(numbers.ratio("mask", "x"), 6).alias("share"))


@query(
    """SELECT o_orderkey, o_orderkey % 700 >= greatest(10 + 600, 10 + ceil((o_orderkey % 900 - 10) * 0.75::DOUBLE)) AS recovered,
    (o_orderkey % 90 = 3 * CAST(round(o_orderkey % 31 / 20.0::DOUBLE * 20.0::DOUBLE) AS BIGINT)) AND o_orderkey % 90 <= 80 AS on_grid FROM orders"""
)
def timeline_checks(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", numbers.recovered(F.lit(10), k % 900, k % 700).alias("recovered"), numbers.timeline_ok((k % 31) / 20.0, k % 90, F.lit(0), F.lit(80)).alias("on_grid"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0::DOUBLE, 480 - greatest(0, l_partkey - 50) / 60.0::DOUBLE), 6) AS clock FROM lineitem")
def game_clock(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(projections.game_timer(F.col("l_partkey") - 50, F.lit(480.0)), 6).alias("clock"))


@query("SELECT doc_id, regexp_matches(lower(text), 'timeout|timed out|temporar|connection (reset|refused|aborted)|unavailable|too many requests|\\b(408|409|425|429|500|502|503|504)\\b') AS passing FROM documents")
def transient_errors(spark, d):
    return table(spark, d, "documents").select("doc_id", text.transient("text").alias("passing"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""")
def csv_fields(spark, d):
    return table(spark, d, "documents").select("doc_id", text.csv_field("text").alias("field"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '(\\d+)(?:\\.[^./]*)?$', 1), '') AS BIGINT) AS number FROM pages WHERE regexp_extract(url, '(\\d+)(?:\\.[^./]*)?$', 1) <> ''")
def numbered_suffixes(spark, d):
    return files.numbered_images(table(spark, d, "pages"), "url").select("page_id", "number")


@query("SELECT c_custkey, nullif(lower(regexp_extract(n, '^([A-Za-z]+)-([A-Za-z]+)-', 1)), '') AS first, nullif(lower(regexp_extract(n, '^([A-Za-z]+)-([A-Za-z]+)-', 2)), '') AS second FROM (SELECT c_custkey, c_mktsegment || '-' || CASE WHEN c_custkey % 2 = 0 THEN 'Gold' ELSE '7' END || '-x' AS n FROM customer)")
def rank_labels(spark, d):
    name = F.concat_ws("-", "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, "Gold").otherwise("7"), F.lit("x"))
    first, second = text.ranks(name)
    return table(spark, d, "customer").select("c_custkey", first.alias("first"), second.alias("second"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS at FROM events")
def utc_stamps(spark, d):
    return table(spark, d, "events").select("event_id", text.utc_stamp("ts").alias("at"))


@query("SELECT doc_id, stage, folder, coalesce(stage = 'BF' AND folder = 'FOX', false) AS wanted FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'BF' WHEN 1 THEN 'FD' END AS stage, CASE WHEN doc_id % 2 = 0 THEN 'FOX' ELSE 'FALCO' END AS folder FROM documents)")
def stage_predicate(spark, d):
    code = F.when(F.col("doc_id") % 3 == 0, " (BF).bin").when(F.col("doc_id") % 3 == 1, " (FD).bin").otherwise(".bin")
    path = F.concat(F.when(F.col("doc_id") % 2 == 0, "FOX").otherwise("FALCO"), F.lit("/game one"), code)
    own = table(spark, d, "documents").select("doc_id", path.alias("path"))
    found = projections.metadata_rows(own.withColumn("target", F.col("path")), keep=("doc_id",))
    return found.select("doc_id", "stage", "folder", projections.in_corpus("stage", F.array("folder"), "BF", ["FOX"]).alias("wanted"))


@query(
    "SELECT o_orderkey, CASE WHEN k < 14 THEN 'dead' WHEN k = 14 THEN 'wait' WHEN k BETWEEN 20 AND 23 THEN 'run' WHEN k BETWEEN 44 AND 74 THEN 'attack' WHEN k >= 300 THEN 'special' ELSE 'other' END AS category FROM (SELECT o_orderkey, o_orderkey % 400 AS k FROM orders)"
)
def state_classes(spark, d):
    rules = [(0, 13, "dead"), (14, 14, "wait"), (20, 23, "run"), (44, 74, "attack"), (300, None, "special")]
    return table(spark, d, "orders").select("o_orderkey", bins.state_class(F.col("o_orderkey") % 400, rules).alias("category"))


@query()
def seed_mixes(spark, d):
    return table(spark, d, "documents").select("doc_id", hashes.seed_mix("source", 3, 7).alias("seed"))


# Runs, projections and actors


@query(
    f"""WITH {T}, p AS (SELECT session, idx // 8 AS row, idx % 8 AS col, mask, lag(mask) OVER (PARTITION BY session ORDER BY idx) AS before FROM t),
    c AS (SELECT *, coalesce(mask % 3 <> before % 3, false) AS hit FROM p),
    s AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER w, false) THEN 1 ELSE 0 END AS start FROM c WINDOW w AS (PARTITION BY session, row ORDER BY col)),
    r AS (SELECT *, sum(start) OVER (PARTITION BY session, row ORDER BY col) AS run FROM s)
    SELECT session, row, min(col) AS "start", max(col) AS "end" FROM r WHERE hit GROUP BY session, row, run"""
)
def changed_spans(spark, d):
    own = _pixels(spark, d)
    return islands.changed_spans(own, ("session", "row")).select("session", "row", "start", "end")


def _pixels(spark, d):
    before = F.lag("mask").over(Window.partitionBy("session").orderBy("idx"))
    own = _ticks(spark, d).withColumn("before", before % 3).withColumn("value", F.col("mask") % 3)
    return own.select("session", F.floor(F.col("idx") / 8).alias("row"), (F.col("idx") % 8).alias("col"), "value", "before")


@query(
    f"""WITH {T}, p AS (SELECT session, idx // 8 AS row, idx % 8 AS col, mask, lag(mask) OVER (PARTITION BY session ORDER BY idx) AS before FROM t)
    SELECT session AS frame, col // 4 AS tile_x, row // 4 AS tile_y FROM p GROUP BY ALL HAVING bool_or(mask % 3 <> before % 3)"""
)
def changed_tiles(spark, d):
    return islands.changed_tiles(_pixels(spark, d).withColumnRenamed("session", "frame"), 4)


@query(
    """SELECT * FROM (SELECT n_nationkey, false AS is_follower, n_name AS actor FROM nation UNION ALL SELECT n_nationkey, true, CASE WHEN n_regionkey <> 1 THEN CAST(n_regionkey AS VARCHAR) END FROM nation) WHERE actor IS NOT NULL"""
)
def actor_rows(spark, d):
    own = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("leader"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey").cast("string")).alias("follower"))
    return ticks.actor_rows(own)


@query(f"WITH {T} SELECT session, count(*) FILTER (mask % 4 = 0) AS empty, count(*) FILTER (mask % 4 <> 0) AS occupied, count(*) FILTER (mask % 4 <> 0 AND x > 20) AS complete, count(*) FILTER (mask % 4 <> 0 AND NOT x > 20) AS skipped FROM t GROUP BY session")
def row_completeness(spark, d):
    return ticks.completeness(_ticks(spark, d), F.col("mask") % 4 != 0, F.col("x") > 20)


@query(f"WITH {T} SELECT session, idx // 2 AS frame, arg_max(state, idx) AS state, arg_max(x, idx) AS x FROM t GROUP BY ALL")
def last_updates(spark, d):
    own = _ticks(spark, d).select("session", F.floor(F.col("idx") / 2).alias("frame"), F.lit(0).alias("player"), F.col("idx").alias("position"), "state", "x")
    return ticks.last_update(own).select("session", "frame", "state", "x")


@query(f"WITH {T}, a AS (SELECT session, idx // 2 AS transition, count(*) AS n FROM t GROUP BY ALL) SELECT session, transition FROM a WHERE n = 2")
def required_actors(spark, d):
    own = _ticks(spark, d).select("session", F.floor(F.col("idx") / 2).alias("transition"), F.col("idx").alias("frame"))
    return ticks.complete(own, 2, ("session", "transition")).select("session", "transition").distinct()


@query("SELECT n_regionkey, count(*) = 5 AND list_sort(list(n_nationkey % 5)) = [0, 1, 2, 3, 4] AS exact, list_contains(list(n_nationkey % 5), 3) AND len(list_distinct(list(n_nationkey % 5))) = 1 AS same FROM nation GROUP BY 1")
def exact_sets(spark, d):
    own = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.col("n_nationkey") % 5).alias("c"))
    return own.select("n_regionkey", sets.matchup(F.lit(31), "c", 31, [0, 1, 2, 3, 4], players=5).alias("exact"), sets.same_set("c", [3]).alias("same"))


@query("SELECT u.reference FROM (SELECT 'c' || c_custkey AS reference FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier) AS u")
def all_references(spark, d):
    return sets.all_references(
        table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("reference")),
        table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("reference")),
    )


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 60")
def eval_subset(spark, d):
    return sets.bounded_subset(table(spark, d, "documents").select("doc_id"), 60, "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 5")
def seed_plan(spark, d):
    docs, done = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return splits.seed_plan(docs, done, "doc_id", done.distinct().count() + 5, "doc_id")


@query("SELECT source, count(*) // 7 AS steps, count(*) % 7 AS rest, CAST(least(100, greatest(1, ceil(count(*) / 3.0::DOUBLE))) AS BIGINT) AS lane FROM documents GROUP BY source")
def epoch_sizes(spark, d):
    steps, rest = splits.steps_per_epoch_of("n", 7)
    sizes = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return sizes.select("source", steps.alias("steps"), rest.alias("rest"), splits.lane_batch_of("n", 3).alias("lane"))


@query(f"WITH {T}, n AS (SELECT session, count(*) AS n FROM t GROUP BY session) SELECT session, p AS place FROM n, unnest(generate_series(0, n - 1)) AS u(p) WHERE p % 3 = 0 OR p = n - 1")
def third_and_last(spark, d):
    sizes = _ticks(spark, d).groupBy("session").agg(F.count("*").alias("n"))
    return sizes.select("session", F.explode(arrays.every_third_and_last("n")).alias("place"))


@query("SELECT doc_id FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) AS q USING (doc_id)")
def unpaired_rows(spark, d):
    return joins.unpaired(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").filter("quality = 1").select("doc_id"), ["doc_id"])


@query("SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings")
def strict_zip(spark, d):
    e = F.col("embedding").cast("array<double>")
    pair = F.element_at(arrays.zip_strict(F.slice(e, 1, 32).alias("a"), F.slice(e, 2, 32).alias("b")), 1)
    return table(spark, d, "embeddings").select("vec_id", pair["a"].alias("a"), pair["b"].alias("b"))


@query(
    """WITH o AS (SELECT n_regionkey, n_nationkey FROM nation) SELECT c.n_regionkey AS clip, f AS frame, count(*) AS actors FROM (SELECT DISTINCT n_regionkey FROM o) c, unnest([0, 1, 2]) AS u(f), (SELECT unnest([0, 1]) AS k) GROUP BY ALL"""
)
def clip_actions(spark, d):
    clips = table(spark, d, "nation").select(F.col("n_regionkey").alias("session")).distinct().withColumn("first_source", F.lit(0)).withColumn("last_source", F.lit(2))
    actions = clips.select("session", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("frame")).select("session", "frame", F.explode(F.array(F.lit(0), F.lit(1))).alias("player"))
    return joins.clip_actions(clips, actions).select(F.col("session").alias("clip"), "frame", F.size("actors").cast("long").alias("actors"))


# Vectors


@query(
    """WITH s AS (SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
    b AS (SELECT quantile_cont(s, 0.08) AS lo, quantile_cont(s, 0.98) AS hi FROM s) SELECT vec_id, round(greatest(0, least(1, (s - lo) / greatest(hi - lo, 1e-12::DOUBLE))), 4) AS level FROM s, b"""
)
def similarity_levels(spark, d):
    rows = table(spark, d, "embeddings")
    found = vectors.similarity_map(rows, "embedding", vectors.example_vector(rows, "vec_id", 0, "embedding"))
    return found.select("vec_id", F.round("level", 4).alias("level"))


@query(
    """WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, round((x[1] + y[1]) / 2 + y[1], 5) AS first FROM p"""
)
def layer_means(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("x")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(F.element_at(arrays.layer_mean_plus_last(["x", "y"]), 1), 5).alias("first"))


# Health and commits


@query(
    f"""WITH {T}, h AS (SELECT session, idx, ts, x, max(x) OVER (PARTITION BY session ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
    r AS (SELECT session, max(ts) AS since, max(x) AS frame FROM h WHERE seen IS NULL OR x > seen GROUP BY session)
    SELECT session AS job, frame FROM r WHERE frame >= 50 AND epoch(TIMESTAMP '2024-02-01') - epoch(since) >= 86400"""
)
def stalled_jobs(spark, d):
    own = _ticks(spark, d).select(F.col("session").alias("job"), F.col("x").alias("frame"), F.col("ts").cast("timestamp").alias("ts"))
    return health.stalled(own, "2024-02-01 00:00:00", 86400, 50).select("job", "frame")


@query("SELECT user_id AS job, count(*) AS cycles, count(*) >= 12 AS given_up, epoch(max(date_trunc('second', ts))) + least(count(*), 20) * 0 AS last FROM events GROUP BY 1")
def deferred_jobs(spark, d):
    own = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"))
    out = health.deferred(own, 0.0, 12)
    return out.select("job", "cycles", "given_up", F.unix_timestamp("next_attempt_at").cast("double").alias("last"))


@query(
    """SELECT d.doc_id, CASE WHEN b.item_id IS NOT NULL THEN 'committed' WHEN l.doc_id IS NULL OR CAST(d.n_chars % 2 AS INTEGER) IS DISTINCT FROM l.quality THEN 'invalid' ELSE 'kept' END AS verdict
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON d.doc_id = b.item_id"""
)
def reconciled_rows(spark, d):
    staged = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    done = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return commit.reconciled(staged, table(spark, d, "labels").select("doc_id", "quality"), done, "doc_id", ("quality",)).select("doc_id", "verdict")


@query("SELECT doc_id, status, coalesce(status IN ('done', 'skipped'), false) AS seeded FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 'done' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'skipped' END AS status FROM documents LEFT JOIN labels USING (doc_id))")
def resumed_jobs(spark, d):
    events = table(spark, d, "labels").select("doc_id", F.lit(1).alias("at"), F.when(F.col("quality") == 1, "done").when(F.col("toxic") == 1, "failed").otherwise("skipped").alias("status"))
    return commit.resumed(table(spark, d, "documents").select("doc_id"), events, "doc_id", "at", ("done", "skipped")).select("doc_id", "status", "seeded")
