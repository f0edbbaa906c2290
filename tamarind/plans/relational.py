"""Queries over the evidence tables: filters, joins, aggregates, windows, sets, text, merges; with their DuckDB texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarind.functions import text as x
from tamarind.functions import urls
from tamarind.operators import joins, merge, similar
from tamarind.operators.quantiles import exact_quantile
from tamarind.session import cut, table
from tamarind.streaming import capture

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is the DuckDB text with the same columns."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _t(s: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(s, d, n) for n in names]


# --- filters, projections, sorts ---------------------------------------------------------------------------------


@query("f1_search_records", "SELECT key, platform, record_type, container_id, coalesce(created_at, captured_at) AS at FROM records WHERE text ILIKE '%land%' AND record_type = 'post' AND match_score > 0 AND captured_at >= TIMESTAMP '2024-06-01'")
def search_records(s, d, words="land", record_type="post", since="2024-06-01"):
    """Conjunctive optional predicates; text is matched without regard to case."""
    (r,) = _t(s, d, "records")
    return r.where(F.col("text").ilike(f"%{words}%") & (F.col("record_type") == record_type) & (F.col("match_score") > 0) & (F.col("captured_at") >= F.lit(since).cast("timestamp"))).select("key", "platform", "record_type", "container_id", F.coalesce("created_at", "captured_at").alias("at"))


@query("f3_any_keyword", "SELECT key, len(matched_keywords) AS keywords FROM records WHERE list_contains(matched_keywords, (SELECT min(k) FROM (SELECT unnest(matched_keywords) AS k FROM records)))")
def any_keyword(s, d):
    (r,) = _t(s, d, "records")
    least = r.select(F.explode("matched_keywords").alias("k")).agg(F.min("k").alias("k"))
    return r.join(F.broadcast(least), F.expr("array_contains(matched_keywords, k)")).select("key", F.size("matched_keywords").alias("keywords"))


@query("f4_newest_page", "SELECT key, coalesce(created_at, captured_at) AS at FROM records ORDER BY coalesce(created_at, captured_at) DESC NULLS LAST, key, captured_at DESC LIMIT 50 OFFSET 100")
def newest_page(s, d):
    (r,) = _t(s, d, "records")
    return r.select("key", F.coalesce("created_at", "captured_at").alias("at"), "captured_at").orderBy(F.col("at").desc_nulls_last(), "key", F.col("captured_at").desc()).offset(100).limit(50).select("key", "at")


@query("f6_due_again", """
    WITH cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY run_id DESC, observation_id DESC) AS n FROM observations) WHERE n = 1),
         r AS (SELECT key, min(content_hash) AS content_hash FROM records GROUP BY key)
    SELECT r.key, cur.observation_id IS NULL AS never FROM r LEFT JOIN cur ON cur.record_key = r.key WHERE cur.observation_id IS NULL OR cur.content_hash IS DISTINCT FROM r.content_hash OR cur.method_version < '1.0.1'""")
def due_again(s, d):
    """Records never observed, changed since, or observed by an older method."""
    r, o = _t(s, d, "records", "observations")
    cur = merge.latest(o, ["record_key"], [F.col("run_id").desc(), F.col("observation_id").desc()]).select("record_key", "observation_id", F.col("content_hash").alias("old"), "method_version")
    one = r.groupBy("key").agg(F.min("content_hash").alias("content_hash"))
    due = F.col("observation_id").isNull() | ~F.col("old").eqNullSafe(F.col("content_hash")) | (F.col("method_version") < "1.0.1")
    return one.join(cur, one["key"] == cur["record_key"], "left").where(due).select("key", F.col("observation_id").isNull().alias("never"))


@query("f12_keyword_gate", """
    SELECT key, len(hits) AS score, array_to_string(hits, ',') AS hits FROM (SELECT key, list_filter(['land', 'house', 'rent', 'sale', 'ດິນ', 'ເຮືອນ', 'ขาย'], lambda k: contains(lower(nfc_normalize(text)), k)) AS hits, lower(nfc_normalize(text)) AS t FROM records WHERE text IS NOT NULL)
    WHERE len(hits) >= 2 AND NOT contains(t, 'wanted') AND NOT contains(t, 'looking to buy')""")
def keyword_gate(s, d):
    """Texts with at least two of the words and none of the excluded ones, in list order."""
    (r,) = _t(s, d, "records")
    words, without = ["land", "house", "rent", "sale", "ດິນ", "ເຮືອນ", "ขาย"], ["wanted", "looking to buy"]
    made = r.where("text is not null").select("key", x.folded("text").alias("t")).select("key", "t", x.keyword_hits(F.col("t"), words).alias("hits"))
    barred = F.size(x.keyword_hits(F.col("t"), without)) > 0
    return made.where((F.size("hits") >= 2) & ~barred).select("key", F.size("hits").alias("score"), F.array_join("hits", ",").alias("hits"))


@query("f19_identifier_kinds", """
    SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(i, '^[0-9a-f]{64}$') THEN 'payload' WHEN regexp_matches(i, '^[a-z]+:[^:]+$') THEN 'record' WHEN regexp_matches(i, '^[0-9]+$') THEN 'number' ELSE 'unknown' END AS kind
    FROM (SELECT key AS i FROM records UNION ALL SELECT payload_hash FROM records WHERE payload_hash IS NOT NULL UNION ALL SELECT cast(claim_id AS varchar) FROM claims UNION ALL SELECT code FROM villages)) GROUP BY kind""")
def identifier_kinds(s, d):
    r, c, v = _t(s, d, "records", "claims", "villages")
    ids = r.select(F.col("key").alias("i")).unionAll(r.select("payload_hash").where("payload_hash is not null")).unionAll(c.select(F.col("claim_id").cast("string"))).unionAll(v.select("code"))
    kind = F.when(F.col("i").rlike("^[0-9a-f]{64}$"), "payload").when(F.col("i").rlike("^[a-z]+:[^:]+$"), "record").when(F.col("i").rlike("^[0-9]+$"), "number").otherwise("unknown")
    return ids.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("s2_verified_bodies", "SELECT status, count(*) AS n, sum(strlen(text)) AS bytes FROM (SELECT text, CASE WHEN strlen(text) > 20000 THEN 'too large' WHEN doc_id % 7 = 0 THEN 'hash differs' ELSE 'accepted' END AS status FROM documents) GROUP BY status")
def verified_bodies(s, d):
    """Documents as raw bodies with their SHA-256; every seventh states another."""
    from tamarind.sources.payloads import verified

    (docs,) = _t(s, d, "documents")
    raw = docs.select(F.col("text").alias("body"), F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.upper(F.sha2("text", 256))).alias("payload_hash"))
    return verified(raw, cap=20_000).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))


# --- merges and windows ------------------------------------------------------------------------------------------


_K6_LAST = "record_type parent_post_id permalink container_id container_name container_type matched_via url_hash author_name author_id author_hash author_url text lang reactions_total comments_count shares_count views_count parser_version payload_hash content_hash sighting_context".split()


@query("k6_merged_records", f"""
    SELECT key, max(captured_at) AS captured_at, max(match_score) AS match_score, max(sightings) AS sightings, min(captured_at) AS first_seen, count(*) AS capture_count,
           {", ".join(f"arg_max({c}, (captured_at, payload_hash)) FILTER ({c} IS NOT NULL) AS {c}" for c in _K6_LAST)},
           {", ".join(f"arg_min({c}, (captured_at, payload_hash)) FILTER ({c} IS NOT NULL) AS {c}" for c in ("platform", "post_id", "created_at"))},
           arg_min(payload_hash, (captured_at, payload_hash)) FILTER (payload_hash IS NOT NULL) AS first_payload_hash,
           {", ".join(f"array_to_string(arg_max({c}, (captured_at, payload_hash)) FILTER (len({c}) > 0), '|') AS {c}" for c in ("matched_keywords", "hashtags"))},
           cardinality(arg_max(reactions_breakdown, (captured_at, payload_hash)) FILTER (reactions_breakdown IS NOT NULL))::INT AS reactions_breakdown,
           len(arg_max(media, (captured_at, payload_hash)) FILTER (len(media) > 0))::INT AS media
    FROM records GROUP BY key""")
def merged_records(s, d):
    (r,) = _t(s, d, "records")
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    joined = lambda c: F.array_join(c, "|").alias(c)
    merged = merge.merged_records(r)
    shown = {"media": size, "reactions_breakdown": size, "matched_keywords": joined, "hashtags": joined}
    return merged.select(*(shown.get(c, F.col)(c) for c in merged.columns))


def _halves(s, d):
    """All events, the first and the second half by order of arrival."""
    (e,) = _t(s, d, "capture_events")
    middle = (e.agg(F.max("id")).first()[0] or 0) // 2  # one number
    return e.where(F.col("id") <= middle), e.where(F.col("id") > middle)


@query("k10_appended_events", """
    SELECT id, record_key, payload_hash, captured_at FROM (
        SELECT *, row_number() OVER (PARTITION BY record_key, payload_hash, captured_at ORDER BY late, id) AS n, late AS part
        FROM (SELECT *, CASE WHEN id <= (SELECT max(id) // 2 FROM capture_events) THEN 0 ELSE 1 END AS late FROM capture_events)) WHERE part = 0 OR n = 1""")
def appended_events(s, d):
    """The first half to arrive is stored as it is; of the second half, each new identity comes once."""
    stored, arrived = _halves(s, d)
    columns = ["id", "record_key", "payload_hash", "captured_at"]
    return merge.appended(stored.select(*columns), arrived.select(*columns), columns[1:], ["id"])


@query("k14_merged_state", """
    WITH c AS (SELECT record_key, payload_hash, id <= (SELECT max(id) // 2 FROM capture_events) AS stored FROM capture_events WHERE record_key IS NOT NULL),
    s AS (SELECT record_key, count(*) AS seen, max(payload_hash) AS digest FROM c WHERE stored GROUP BY record_key),
    a AS (SELECT record_key, count(*) AS seen, max(payload_hash) AS digest FROM c WHERE NOT stored GROUP BY record_key)
    SELECT coalesce(a.record_key, s.record_key) AS record_key, coalesce(a.seen, s.seen) AS seen, coalesce(a.digest, s.digest) AS digest,
           CASE WHEN s.record_key IS NULL THEN 'inserted' WHEN a.record_key IS NULL THEN 'missing' WHEN a.seen <> s.seen OR (a.digest IS NOT NULL AND a.digest IS DISTINCT FROM s.digest) THEN 'updated' ELSE 'kept' END AS change
    FROM s FULL JOIN a ON s.record_key = a.record_key""")
def merged_state(s, d):
    """The state of the keys of the first half to arrive, after the second half."""
    state = lambda e: e.where("record_key is not null").groupBy("record_key").agg(F.count("*").alias("seen"), F.max("payload_hash").alias("digest"))
    return merge.merged_state(*map(state, _halves(s, d)), ["record_key"])


@query("k7_events_once", "SELECT record_key, payload_hash, captured_at, min(id) AS id, count(*) AS copies FROM capture_events GROUP BY record_key, payload_hash, captured_at")
def events_once(s, d):
    (e,) = _t(s, d, "capture_events")
    return e.groupBy("record_key", "payload_hash", "captured_at").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


@query("k8_first_payloads", "SELECT payload_hash, id, record_key FROM (SELECT *, row_number() OVER (PARTITION BY payload_hash ORDER BY captured_at, id) AS n FROM capture_events WHERE payload_hash IS NOT NULL) WHERE n = 1")
def first_payloads(s, d):
    (e,) = _t(s, d, "capture_events")
    return merge.latest(e.where("payload_hash is not null"), ["payload_hash"], [F.col("captured_at"), F.col("id")]).select("payload_hash", "id", "record_key")


@query("k7_new_events", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY record_key, payload_hash, captured_at ORDER BY id) AS n FROM capture_events WHERE captured_at >= TIMESTAMP '2025-06-01'), old AS (SELECT * FROM capture_events WHERE captured_at < TIMESTAMP '2025-06-01' OR id % 5 = 0)
    SELECT id FROM b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old WHERE old.record_key = b.record_key AND old.payload_hash IS NOT DISTINCT FROM b.payload_hash AND old.captured_at = b.captured_at)""")
def new_events(s, d):
    """Events of a late batch whose identity is not stored yet."""
    (e,) = _t(s, d, "capture_events")
    late = F.col("captured_at") >= F.lit("2025-06-01").cast("timestamp")
    return merge.new_only(e.where(~late | (F.col("id") % 5 == 0)), e.where(late), ["record_key", "payload_hash", "captured_at"], ["id"]).select("id")


@query("k9_seen_links", "SELECT url_hash, max(captured_at) AS updated_at, count(*) AS fetch_count, arg_max(record_type, (captured_at, key)) AS last_kind FROM records WHERE url_hash IS NOT NULL GROUP BY url_hash")
def seen_links(s, d):
    (r,) = _t(s, d, "records")
    return r.where("url_hash is not null").groupBy("url_hash").agg(F.max("captured_at").alias("updated_at"), F.count("*").alias("fetch_count"), F.max_by("record_type", F.struct("captured_at", "key")).alias("last_kind"))


@query("t1_sightings", """
    SELECT id, CASE WHEN n = 1 THEN 'new' WHEN coalesce(before <> payload_hash, true) THEN 'changed' WHEN m > 1 THEN 'repeat' ELSE 'new_context' END AS decision
    FROM (SELECT id, payload_hash, row_number() OVER w AS n, lag(payload_hash) OVER w AS before, row_number() OVER (PARTITION BY record_key, context ORDER BY captured_at, id) AS m FROM capture_events WINDOW w AS (PARTITION BY record_key ORDER BY captured_at, id))""")
def sightings(s, d):
    (e,) = _t(s, d, "capture_events")
    return merge.sightings(e).select("id", "decision")


@query("w1_current_observations", "SELECT record_key, observation_id FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY run_id DESC, observation_id DESC) AS n FROM observations) WHERE n = 1")
def current_observations(s, d):
    (o,) = _t(s, d, "observations")
    return merge.latest(o, ["record_key"], [F.col("run_id").desc(), F.col("observation_id").desc()]).select("record_key", "observation_id")


@query("w5_last_three_sightings", "SELECT record_key, id FROM (SELECT *, row_number() OVER (PARTITION BY record_key ORDER BY captured_at DESC, id DESC) AS n FROM capture_events) WHERE n <= 3")
def last_three(s, d):
    (e,) = _t(s, d, "capture_events")
    return merge.latest(e, ["record_key"], [F.col("captured_at").desc(), F.col("id").desc()], 3).select("record_key", "id")


@query("w7_running_bytes", "SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents")
def running_bytes(s, d):
    (docs,) = _t(s, d, "documents")
    return merge.running_total(docs.select("doc_id", F.octet_length("text").cast("long").alias("bytes")), "doc_id", "bytes").select("doc_id", "running")


@query("w8_last_post_before", "SELECT key, last_value(CASE WHEN record_type = 'post' THEN key END IGNORE NULLS) OVER (PARTITION BY container_id ORDER BY captured_at, key, payload_hash ROWS UNBOUNDED PRECEDING) AS last_post FROM records WHERE container_id IS NOT NULL AND record_type IS NOT NULL")
def last_post_before(s, d):
    """The post last seen in the same container before each record; a container is worked off by days."""
    (r,) = _t(s, d, "records")
    order = ["captured_at", "key", "payload_hash"]
    rows = r.where("container_id is not null and record_type is not null").select("container_id", *order, F.to_date("captured_at").alias("day"), F.when(F.col("record_type") == "post", F.col("key")).alias("post"))
    inside = F.last("post", ignorenulls=True).over(Window.partitionBy("container_id", "day").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    days = rows.groupBy("container_id", "day").agg(F.max_by("post", F.when(F.col("post").isNotNull(), F.struct(*order))).alias("of_day"))
    before = days.withColumn("before", F.last("of_day", ignorenulls=True).over(Window.partitionBy("container_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).drop("of_day")
    return rows.withColumn("inside", inside).join(before.withColumnRenamed("day", "d2").withColumnRenamed("container_id", "c2"), (F.col("container_id") == F.col("c2")) & F.col("day").eqNullSafe(F.col("d2"))).select("key", F.coalesce("inside", "before").alias("last_post"))


@query("k3_first_push", """
    SELECT key, payload_hash, captured_at, running FROM (SELECT key, payload_hash, captured_at, sum(strlen(text)) OVER w AS running, row_number() OVER w AS n FROM records WHERE text IS NOT NULL AND container_id IS NOT NULL AND strlen(text) <= 4000
    WINDOW w AS (PARTITION BY container_id ORDER BY captured_at, key, payload_hash ROWS UNBOUNDED PRECEDING)) WHERE running <= 4000 AND n <= 25""")
def first_push(s, d, most_bytes=4_000, most_rows=25):
    """Per container the oldest rows that fit one push by bytes and count; rows too large for any push are passed over."""
    (r,) = _t(s, d, "records")
    w = Window.partitionBy("container_id").orderBy("captured_at", "key", "payload_hash").rowsBetween(Window.unboundedPreceding, 0)
    rows = r.where(F.col("text").isNotNull() & F.col("container_id").isNotNull()).withColumn("bytes", F.octet_length("text").cast("long")).where(F.col("bytes") <= most_bytes)
    # The first rows of each container are cut out before the shuffle; only these are added up.
    first = merge.latest(rows, ["container_id"], [F.col(c) for c in ("captured_at", "key", "payload_hash")], most_rows)
    return first.withColumn("running", F.sum("bytes").over(w)).where(F.col("running") <= most_bytes).select("key", "payload_hash", "captured_at", "running")


@query("k3_pushes")
def all_pushes(s, d):
    """Every row with text and container with the number of its push, at the reference's 4 MB and 25 rows; rows too large for any push are flagged."""
    (r,) = _t(s, d, "records")
    rows = r.where(F.col("text").isNotNull() & F.col("container_id").isNotNull()).select("key", "payload_hash", "captured_at", "container_id", F.octet_length("text").cast("long").alias("bytes"))
    return merge.pushes(rows, "container_id", ["captured_at", "key", "payload_hash"], "bytes")


@query("k15_payloads_wanted", "SELECT e.payload_hash, min(e.captured_at) AS oldest FROM capture_events e WHERE e.payload_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM records r WHERE r.payload_hash = e.payload_hash) GROUP BY 1 ORDER BY oldest, 1 LIMIT 50")
def payloads_wanted(s, d):
    """The oldest payloads that were sighted but are not stored (a top list)."""
    e, r = _t(s, d, "capture_events", "records")
    gone = e.where("payload_hash is not null").join(r.select("payload_hash"), "payload_hash", "left_anti")
    return gone.groupBy("payload_hash").agg(F.min("captured_at").alias("oldest")).orderBy("oldest", "payload_hash").limit(50)


@query("t5_stage_lag", """
    SELECT 'extract' AS stage, count(*) AS pending, min(captured_at) AS oldest FROM (SELECT key, min(captured_at) AS captured_at FROM records GROUP BY key) r WHERE NOT EXISTS (SELECT 1 FROM observations WHERE record_key = key)
    UNION ALL SELECT 'locate', count(*), min(observed_at) FROM observations o WHERE NOT EXISTS (SELECT 1 FROM resolved_locations l WHERE l.observation_id = o.observation_id)
    UNION ALL SELECT 'price', count(*), min(created_at) FROM (SELECT DISTINCT claim_id, created_at FROM claims WHERE field = 'PRICE') c WHERE NOT EXISTS (SELECT 1 FROM price_observations p WHERE p.claim_id = c.claim_id)""")
def stage_lag(s, d):
    """What each stage has still to do, and since when."""
    r, o, l, c, p = _t(s, d, "records", "observations", "resolved_locations", "claims", "price_observations")
    count = lambda df, at, stage: df.agg(F.count("*").alias("pending"), F.min(at).alias("oldest")).select(F.lit(stage).alias("stage"), "pending", "oldest")
    records = r.groupBy("key").agg(F.min("captured_at").alias("captured_at")).join(o.select(F.col("record_key").alias("key")), "key", "left_anti")
    prices = c.where("field = 'PRICE'").select("claim_id", "created_at").distinct().join(p.select("claim_id"), "claim_id", "left_anti")
    return count(records, "captured_at", "extract").unionByName(count(o.join(l.select("observation_id"), "observation_id", "left_anti"), "observed_at", "locate")).unionByName(count(prices, "created_at", "price"))


@query("t8_past_retention", "SELECT DISTINCT r.key FROM records r WHERE r.captured_at < TIMESTAMP '2025-01-01' AND NOT EXISTS (SELECT 1 FROM observations o WHERE o.record_key = r.key) AND NOT EXISTS (SELECT 1 FROM records n WHERE n.key = r.key AND n.captured_at >= TIMESTAMP '2025-01-01')")
def past_retention(s, d, before="2025-01-01"):
    """Records last captured before a day and protected by no observation."""
    r, o = _t(s, d, "records", "observations")
    old = r.groupBy("key").agg(F.max("captured_at").alias("last"), F.min("captured_at").alias("first")).where(F.col("last") < F.lit(before).cast("timestamp"))
    return old.join(o.select(F.col("record_key").alias("key")), "key", "left_anti").select("key")


@query("h1_reconciliation", """
    SELECT 'records sighted' AS name, count(*) AS whole, count(*) FILTER (EXISTS (SELECT 1 FROM capture_events WHERE record_key = k)) AS met FROM (SELECT DISTINCT key AS k FROM records)
    UNION ALL SELECT 'events with record', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM records WHERE key = record_key)) FROM capture_events
    UNION ALL SELECT 'observations with record', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM records WHERE key = record_key)) FROM observations
    UNION ALL SELECT 'claims with observation', count(*), count(*) FILTER (EXISTS (SELECT 1 FROM observations o WHERE o.observation_id = claims.observation_id)) FROM claims""")
def reconciliation(s, d):
    """How many rows of each layer have what they were derived from."""
    r, e, o, c = _t(s, d, "records", "capture_events", "observations", "claims")

    def check(name, rows, key, other, other_key):
        known = other.select(F.col(other_key).alias("_k")).distinct()
        return rows.join(known, rows[key] == F.col("_k"), "left").agg(F.count("*").alias("whole"), F.count("_k").alias("met")).select(F.lit(name).alias("name"), "whole", "met")

    keys = r.select("key").distinct()
    return check("records sighted", keys, "key", e, "record_key").unionByName(check("events with record", e, "record_key", r, "key")).unionByName(check("observations with record", o, "record_key", r, "key")).unionByName(check("claims with observation", c, "observation_id", o, "observation_id"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("j1_events_with_records", "SELECT e.context IS NULL AS no_context, count(*) AS events, count(r.key) AS known FROM capture_events e LEFT JOIN (SELECT DISTINCT key FROM records) r ON r.key = e.record_key GROUP BY 1")
def events_with_records(s, d):
    e, r = _t(s, d, "capture_events", "records")
    return e.join(r.select("key").distinct(), e["record_key"] == F.col("key"), "left").groupBy(F.col("context").isNull().alias("no_context")).agg(F.count("*").alias("events"), F.count("key").alias("known"))


@query("j2_observed_records", "SELECT DISTINCT key FROM records WHERE EXISTS (SELECT 1 FROM observations WHERE record_key = key)")
def observed(s, d):
    r, o = _t(s, d, "records", "observations")
    return r.join(o, r["key"] == o["record_key"], "left_semi").select("key").distinct()


@query("j3_unobserved_records", "SELECT DISTINCT key FROM records WHERE NOT EXISTS (SELECT 1 FROM observations WHERE record_key = key)")
def unobserved(s, d):
    r, o = _t(s, d, "records", "observations")
    return r.join(o, r["key"] == o["record_key"], "left_anti").select("key").distinct()


@query("j4_superseded_claims", "SELECT c.claim_id FROM (SELECT DISTINCT claim_id, observation_id, field, span_start FROM claims) c WHERE NOT EXISTS (SELECT 1 FROM claims n WHERE n.observation_id = c.observation_id AND n.field = c.field AND n.span_start = c.span_start AND n.claim_id > c.claim_id)")
def unsuperseded(s, d):
    """Claims with no later claim of the same place."""
    (c,) = _t(s, d, "claims")
    return c.where("observation_id is not null and field is not null and span_start is not null").groupBy("observation_id", "field", "span_start").agg(F.max("claim_id").alias("claim_id")).select("claim_id")


@query("j7_best_claims", """
    SELECT observation_id, arg_max(value_text, (confidence, -claim_id)) FILTER (field = 'AREA') AS area, arg_max(value_text, (confidence, -claim_id)) FILTER (field = 'PRICE') AS price, arg_max(value_text, (confidence, -claim_id)) FILTER (field = 'LOCATION_TEXT') AS location_text
    FROM claims GROUP BY observation_id""")
def best_claims(s, d):
    (c,) = _t(s, d, "claims")
    return joins.best_children(c.withColumn("first", -F.col("claim_id")), "observation_id", "field", ["AREA", "PRICE", "LOCATION_TEXT"], "value_text", ["confidence", "first"])


@query("j8_rates_as_of", """
    WITH f AS (SELECT currency, rate_date, max(lak_per_unit) AS r FROM fx_rates GROUP BY ALL)
    SELECT p.price_observation_id, f.rate_date, cast(f.r AS double) AS rate FROM (SELECT DISTINCT price_observation_id, currency_original, cast(coalesce(post_date, observed_at) AS date) AS day FROM price_observations) p
    LEFT JOIN f ON f.currency = p.currency_original AND f.rate_date = (SELECT max(g.rate_date) FROM f g WHERE g.currency = p.currency_original AND g.rate_date <= p.day AND g.rate_date >= p.day - 7)""")
def rates_as_of(s, d):
    p, f = _t(s, d, "price_observations", "fx_rates")
    left = p.select("price_observation_id", F.col("currency_original").alias("currency"), F.to_date(F.coalesce("post_date", "observed_at")).alias("day")).distinct()
    return joins.asof(left, f, "currency", "day", "rate_date", "lak_per_unit").select("price_observation_id", "rate_date", F.col("lak_per_unit").cast("double").alias("rate"))


@query("j9_comments_of_posts", "SELECT p.key, count(c.key) AS comments, max(c.captured_at) AS newest FROM (SELECT DISTINCT key, post_id, platform FROM records WHERE record_type = 'post') p LEFT JOIN (SELECT DISTINCT key, parent_post_id, platform, captured_at FROM records WHERE record_type = 'comment') c ON c.parent_post_id = p.post_id AND c.platform = p.platform GROUP BY p.key")
def comments_of_posts(s, d):
    (r,) = _t(s, d, "records")
    p = r.where("record_type = 'post'").select("key", "post_id", "platform").distinct()
    # Comments are added up per parent first, so a post with a third of them costs one row.
    c = r.where("record_type = 'comment' and parent_post_id is not null").select("key", "parent_post_id", "platform", "captured_at").distinct().groupBy(F.col("parent_post_id").alias("post_id"), "platform").agg(F.count("*").alias("comments"), F.max("captured_at").alias("newest"))
    return p.join(c, ["post_id", "platform"], "left").select("key", F.coalesce("comments", F.lit(0)).alias("comments"), "newest")


@query("j10_promoted_keywords", """
    SELECT p.key, list_sort(list_distinct(list_concat(coalesce(p.own, []), coalesce(c.more, [])))) AS keywords FROM (SELECT key, any_value(post_id) AS post_id, list_distinct(flatten(list(matched_keywords))) AS own FROM records WHERE record_type = 'post' GROUP BY key) p
    JOIN (SELECT parent_post_id, list_distinct(flatten(list(matched_keywords))) AS more FROM records WHERE record_type = 'comment' AND parent_post_id IS NOT NULL GROUP BY 1) c ON c.parent_post_id = p.post_id""")
def promoted_keywords(s, d):
    """Keywords of posts together with those of their comments."""
    (r,) = _t(s, d, "records")
    words = r.select("key", "post_id", "record_type", "parent_post_id", F.explode_outer("matched_keywords").alias("k"))
    c = words.where("record_type = 'comment' and parent_post_id is not null").groupBy(F.col("parent_post_id").alias("post_id")).agg(F.collect_set("k").alias("more"))
    p = words.where("record_type = 'post'").groupBy("key").agg(F.first("post_id").alias("post_id"), F.collect_set("k").alias("own"))
    return p.join(c, "post_id").select("key", F.array_sort(F.array_union("own", "more")).alias("keywords"))


@query("j11_blocks", """
    SELECT o.observation_id, min(o.observation_id) OVER (PARTITION BY l.village_code, o.asset_type) AS block, count(*) OVER (PARTITION BY l.village_code, o.asset_type) AS members
    FROM observations o JOIN (SELECT DISTINCT observation_id, village_code FROM resolved_locations WHERE village_code IS NOT NULL) l USING (observation_id) WHERE o.asset_type IS NOT NULL""")
def blocks(s, d):
    """Observations of one village and asset type as a block with a representative, not as pairs."""
    o, l = _t(s, d, "observations", "resolved_locations")
    rows = o.join(l.where("village_code is not null").select("observation_id", "village_code").distinct(), "observation_id").where("asset_type is not null").select("observation_id", "village_code", "asset_type")
    per = rows.groupBy("village_code", "asset_type").agg(F.min("observation_id").alias("block"), F.count("*").alias("members"))
    return rows.join(per, ["village_code", "asset_type"]).select("observation_id", "block", "members")


@query("j12_near_villages", """
    SELECT a, b, round(m, 3) AS metres FROM (SELECT p.code AS a, q.code AS b, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(q.centroid_lat - p.centroid_lat) / 2), 2) + cos(radians(p.centroid_lat)) * cos(radians(q.centroid_lat)) * pow(sin(radians(q.centroid_lng - p.centroid_lng) / 2), 2))) AS m
    FROM villages p JOIN villages q ON p.code < q.code) WHERE m <= 15000""")
def near_villages(s, d):
    (v,) = _t(s, d, "villages")
    return joins.near_pairs(v, "code", "centroid_lat", "centroid_lng", 15_000).select("a", "b", F.round("metres", 3).alias("metres"))


#: Precisions of a point that a blocking by distance may trust; others are centroids of units.
PRECISE = ("EXACT_COORDINATE", "PARCEL_APPROXIMATE")


def _located(s, d):
    l = _t(s, d, "resolved_locations")[0]
    return l.select("resolved_location_id", "observation_id", "lat", "lng", F.coalesce(F.col("precision").isin(*PRECISE), F.lit(False)).alias("precise")).where("observation_id is not null")


@query("j12_point_members", """
    SELECT resolved_location_id, observation_id, min(resolved_location_id) OVER w AS point, count(*) OVER w AS copies, precise
    FROM (SELECT DISTINCT resolved_location_id, observation_id, lat, lng, coalesce(precision IN ('EXACT_COORDINATE', 'PARCEL_APPROXIMATE'), false) AS precise FROM resolved_locations WHERE observation_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL) WINDOW w AS (PARTITION BY lat, lng)""")
def point_members(s, d):
    """Every located observation with the least location of its very point; all members of a point are near each other."""
    rows = _located(s, d)
    return joins.same_points(rows, "resolved_location_id", "lat", "lng").join(rows.select("resolved_location_id", "observation_id", "precise").distinct(), "resolved_location_id").select("resolved_location_id", "observation_id", "point", "copies", "precise")


@query("j12_near_points", """
    WITH p AS (SELECT min(resolved_location_id) AS k, lat, lng, bool_or(coalesce(precision IN ('EXACT_COORDINATE', 'PARCEL_APPROXIMATE'), false)) AS precise FROM resolved_locations WHERE observation_id IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL GROUP BY lat, lng)
    SELECT a, b, round(m, 3) AS metres, precise FROM (SELECT p.k AS a, q.k AS b, p.precise AND q.precise AS precise, 2 * 6371000.0 * asin(sqrt(pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lng - p.lng) / 2), 2))) AS m
    FROM p JOIN p q ON p.k < q.k) WHERE m <= 300""")
def near_points(s, d):
    """Links within 300 m between distinct points of observations, by their least locations; ``precise`` where both have a member that the reference would block."""
    points = _located(s, d).where("lat is not null and lng is not null").groupBy("lat", "lng").agg(F.min("resolved_location_id").alias("k"), F.max("precise").alias("precise"))
    links = joins.near_pairs(points, "k", "lat", "lng", 300)
    of = lambda end: points.select(F.col("k").alias(end), F.col("precise").alias(f"p_{end}"))
    return links.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.round("metres", 3).alias("metres"), (F.col("p_a") & F.col("p_b")).alias("precise"))


@query("j14_names_exact", "SELECT DISTINCT c.claim_id, v.code FROM (SELECT DISTINCT claim_id, value_text FROM claims WHERE field = 'LOCATION_TEXT') c JOIN (SELECT code, unnest(list_concat([name_lo, name_en], coalesce(name_variants, []))) AS n FROM villages) v ON lower(trim(c.value_text)) = lower(v.n)")
def names_exact(s, d):
    c, v = _t(s, d, "claims", "villages")
    names = v.select("code", F.explode(F.concat(F.array("name_lo", "name_en"), F.coalesce("name_variants", F.array().cast("array<string>")))).alias("n")).select("code", F.lower("n").alias("n"))
    values = c.where("field = 'LOCATION_TEXT'").select("claim_id", F.lower(F.trim("value_text")).alias("n")).distinct()
    return values.join(names, "n").select("claim_id", "code").distinct()


@query("j15_similar_districts", """
    WITH g AS (SELECT code, list_distinct(list_transform(range(1, greatest(length(n) - 1, 1) + 1), lambda i: substring(n, i, 2))) AS g FROM (SELECT code, lower(regexp_replace(name_en, '\\s+', '', 'g')) AS n FROM districts))
    SELECT p.code AS a, q.code AS b, round(2 * len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g)), 6) AS score FROM g p, g q WHERE 2 * len(list_intersect(p.g, q.g)) / (len(p.g) + len(q.g)) >= 0.6""")
def similar_districts(s, d):
    (v,) = _t(s, d, "districts")
    return joins.similar_names(v, v, "code", "name_en", 0.6)


@query("j20_lineage", """
    WITH o AS (SELECT DISTINCT record_key AS src, 'obs:' || observation_id AS dst FROM observations), c AS (SELECT DISTINCT 'obs:' || observation_id AS src, 'claim:' || claim_id AS dst FROM claims), p AS (SELECT DISTINCT 'claim:' || claim_id AS src, 'price:' || price_observation_id AS dst FROM price_observations)
    SELECT k.key AS start, (SELECT 1) AS depth, count(DISTINCT o.dst) AS nodes FROM (SELECT DISTINCT key FROM records) k JOIN o ON o.src = k.key GROUP BY 1
    UNION ALL SELECT k.key, 2, count(DISTINCT c.dst) FROM (SELECT DISTINCT key FROM records) k JOIN o ON o.src = k.key JOIN c ON c.src = o.dst GROUP BY 1
    UNION ALL SELECT k.key, 3, count(DISTINCT p.dst) FROM (SELECT DISTINCT key FROM records) k JOIN o ON o.src = k.key JOIN c ON c.src = o.dst JOIN p ON p.src = c.dst GROUP BY 1""")
def lineage(s, d):
    """What was derived from each record, by distance."""
    r, o, c, p = _t(s, d, "records", "observations", "claims", "price_observations")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    edges = o.select(F.col("record_key").alias("src"), name("obs", "observation_id").alias("dst")).unionByName(c.select(name("obs", "observation_id").alias("src"), name("claim", "claim_id").alias("dst"))).unionByName(p.select(name("claim", "claim_id").alias("src"), name("price", "price_observation_id").alias("dst"))).distinct()
    found = joins.walk(edges, r.select(F.col("key").alias("node")), 3)
    return found.where("distance > 0").groupBy("start", F.col("distance").alias("depth")).agg(F.count("*").alias("nodes"))


@query("j15_similar_places")
def similar_places(s, d):
    """Every distinct location text against all names of villages and districts: matches of a Dice score of at least 0.6 with their rank by level."""
    c, v, u = _t(s, d, "claims", "villages", "districts")
    texts = c.where("field = 'LOCATION_TEXT' and value_text is not null").select(F.col("value_text").alias("n")).distinct()
    of = lambda t, level: t.select(F.lit(level).alias("level"), "code", F.explode(F.concat(F.array("name_lo", "name_en"), F.coalesce("name_variants", F.array().cast("array<string>")))).alias("n"))
    names = of(v, "village").unionByName(of(u, "district")).where("n is not null").distinct()
    keyed = lambda t: t.select(F.col("n").alias("k"), "n").distinct()
    pairs = joins.similar_names(keyed(texts), keyed(names), "k", "n", 0.6)
    best = pairs.join(names, pairs["b"] == names["n"]).groupBy(F.col("a").alias("text"), "level", "code").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("text", "level").orderBy(F.col("score").desc(), "code")))


_EDGES = """
    e AS (SELECT 'payload:' || payload_hash AS src, 'record:' || record_key AS dst FROM capture_events UNION SELECT 'payload:' || payload_hash, 'record:' || key FROM records
        UNION SELECT 'record:' || record_key, 'obs:' || observation_id FROM observations UNION SELECT 'record:' || record_a, 'cluster:' || cluster_id FROM cluster_edges UNION SELECT 'record:' || record_b, 'cluster:' || cluster_id FROM cluster_edges
        UNION SELECT 'obs:' || observation_id, 'claim:' || claim_id FROM claims UNION SELECT 'obs:' || observation_id, 'loc:' || resolved_location_id FROM resolved_locations UNION SELECT 'claim:' || claim_id, 'price:' || price_observation_id FROM price_observations)"""


def lineage_edges(s, d) -> DataFrame:
    """``(src, dst)`` from what was taken to what was derived: payload, record, observation or cluster, claim or location, price."""
    r, e, o, c, p, l, k = _t(s, d, "records", "capture_events", "observations", "claims", "price_observations", "resolved_locations", "cluster_edges")
    name = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))
    some = lambda t, a, x, b, y: t.select(name(a, x).alias("src"), name(b, y).alias("dst"))
    parts = [
        some(e, "payload", "payload_hash", "record", "record_key"), some(r, "payload", "payload_hash", "record", "key"), some(o, "record", "record_key", "obs", "observation_id"), some(k, "record", "record_a", "cluster", "cluster_id"), some(k, "record", "record_b", "cluster", "cluster_id"),
        some(c, "obs", "observation_id", "claim", "claim_id"), some(l, "obs", "observation_id", "loc", "resolved_location_id"), some(p, "claim", "claim_id", "price", "price_observation_id"),
    ]
    return reduce(DataFrame.unionByName, parts).where("src is not null and dst is not null").distinct()


@query("j20_lineage_both", f"""
    WITH RECURSIVE {_EDGES.strip()}, g AS (SELECT 'down' AS way, src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT 'up', dst, src FROM e WHERE src IS NOT NULL AND dst IS NOT NULL),
        w AS (SELECT way, src AS start, dst AS node, 1 AS depth FROM g UNION SELECT w.way, w.start, g.dst, w.depth + 1 FROM w JOIN g ON g.way = w.way AND g.src = w.node)
    SELECT start, way, depth, split_part(node, ':', 1) AS kind, count(*) AS nodes FROM w GROUP BY ALL""")
def lineage_both(s, d):
    """From every payload, record, observation, cluster, claim, location and price: what was derived from it (down) and what it was derived from (up), by distance and kind."""
    edges = cut(lineage_edges(s, d))

    def walked(way, g):
        found = joins.walk(g, g.select(F.col("src").alias("node")), 4).where("distance > 0")
        return found.groupBy("start", F.col("distance").alias("depth"), F.substring_index("node", ":", 1).alias("kind")).agg(F.count("*").alias("nodes")).select("start", F.lit(way).alias("way"), "depth", "kind", "nodes")

    return walked("down", edges).unionByName(walked("up", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query("j23_observation_detail", """
    SELECT o.observation_id, (SELECT list_sort(list(DISTINCT c.claim_id)) FROM claims c WHERE c.observation_id = o.observation_id) AS claims, (SELECT list_sort(list(DISTINCT p.price_observation_id)) FROM price_observations p WHERE p.observation_id = o.observation_id) AS prices FROM observations o""")
def observation_detail(s, d):
    o, c, p = _t(s, d, "observations", "claims", "price_observations")
    some = lambda t, k, n: t.groupBy("observation_id").agg(F.sort_array(F.collect_set(k)).alias(n))
    return o.select("observation_id").join(some(c, "claim_id", "claims"), "observation_id", "left").join(some(p, "price_observation_id", "prices"), "observation_id", "left")


@query("j24_page_targets", "SELECT regexp_extract(page_url, '^https://[^/]+/groups/[^/?#]+') AS target, count(*) AS events, count(DISTINCT record_key) AS records FROM capture_events WHERE regexp_matches(page_url, '^https://[^/]+/groups/[^/?#]+') GROUP BY 1")
def page_targets(s, d):
    (e,) = _t(s, d, "capture_events")
    t = F.regexp_extract("page_url", r"^(https://[^/]+/groups/[^/?#]+)", 1)
    return e.where(t != "").groupBy(t.alias("target")).agg(F.count("*").alias("events"), F.countDistinct("record_key").alias("records"))


@query("j24_target_pages", """
    WITH t AS (SELECT DISTINCT regexp_extract(permalink, '^https://[^/]+/groups/[^/?#]+') AS target FROM records WHERE permalink LIKE 'https://%/groups/%'
               UNION SELECT DISTINCT regexp_extract(page_url, '^https://[^/]+/market') FROM capture_events WHERE page_url LIKE 'https://%/market%'),
         p AS (SELECT regexp_replace(page_url, '/+$', '') AS page, count(*) AS n FROM capture_events WHERE page_url LIKE 'https://%' GROUP BY 1)
    SELECT target, count(*) AS pages, sum(n)::BIGINT AS events FROM t JOIN p ON page = target OR starts_with(page, target || '/') WHERE target <> '' GROUP BY target""")
def target_pages(s, d):
    """Pages that are a target or lie below one; targets are the groups of the records and the market pages.  Every beginning of a page is looked up, so the join is an equality."""
    r, e = _t(s, d, "records", "capture_events")
    groups = r.where("permalink like 'https://%/groups/%'").select(F.regexp_extract("permalink", "^https://[^/]+/groups/[^/?#]+", 0).alias("target"))
    markets = e.where("page_url like 'https://%/market%'").select(F.regexp_extract("page_url", "^https://[^/]+/market", 0).alias("target"))
    pages = e.where("page_url like 'https://%'").groupBy(F.regexp_replace("page_url", "/+$", "").alias("page")).agg(F.count("*").alias("n"))
    below = pages.select("page", "n", F.explode(urls.targets_of(F.col("page"))).alias("target"))
    return groups.union(markets).where("target <> ''").distinct().join(below, "target").groupBy("target").agg(F.count("*").alias("pages"), F.sum("n").alias("events"))


@query("x5_claim_slices", """
    SELECT claim_id, substring(nfc_normalize(text), span_start + 1, span_end - span_start) AS slice
    FROM (SELECT DISTINCT claim_id, observation_id, span_start, span_end FROM claims) c JOIN (SELECT DISTINCT observation_id, record_key FROM observations) o USING (observation_id)
    JOIN (SELECT key, min(text) AS text FROM records WHERE text IS NOT NULL GROUP BY key) r ON r.key = o.record_key WHERE NOT regexp_matches(text, '[\\x{10000}-\\x{10FFFF}]')""")
def claim_slices(s, d):
    """The text that each claim's span marks, for texts whose UTF-16 units are their code points, as SQL can cut only these."""
    return all_claim_slices(s, d).where(~F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]")).select("claim_id", "slice")


@query("x5_all_claim_slices")
def all_claim_slices(s, d):
    """The text that each claim's span marks, in UTF-16 units of the composed text."""
    c, o, r = _t(s, d, "claims", "observations", "records")
    texts = r.where("text is not null").groupBy(F.col("key").alias("record_key")).agg(F.min("text").alias("text"))
    marked = c.select("claim_id", "observation_id", "span_start", "span_end").distinct().join(o.select("observation_id", "record_key").distinct(), "observation_id").join(texts, "record_key")
    return marked.select("claim_id", x.utf16_slice("text", "span_start", "span_end").alias("slice"), "text")


@query("t8_purged", """
    WITH old AS (SELECT key FROM records GROUP BY key HAVING max(captured_at) < TIMESTAMP '2025-01-01'),
    gone AS (SELECT key FROM old WHERE key NOT IN (SELECT record_key FROM observations WHERE record_key IS NOT NULL))
    SELECT key, captured_at, payload_hash FROM records WHERE key IS NULL OR key NOT IN (SELECT key FROM gone WHERE key IS NOT NULL)""")
def purged(s, d, before="2025-01-01"):
    """The records that stay when those past their retention are removed."""
    r, o = _t(s, d, "records", "observations")
    stays, _ = merge.purged(r, "captured_at", F.lit(before).cast("timestamp"), o.select(F.col("record_key").alias("key")))
    return stays.select("key", "captured_at", "payload_hash")


@query("s3_seen_since", "SELECT url_hash, max(captured_at) AS updated_at FROM records WHERE url_hash IS NOT NULL GROUP BY url_hash HAVING (max(captured_at), url_hash) > (TIMESTAMP '2025-06-01', '') ORDER BY updated_at, url_hash LIMIT 500")
def seen_since(s, d, since="2025-06-01", page=500):
    """Links seen since a time, a page of them (a paged list)."""
    (r,) = _t(s, d, "records")
    seen = r.where("url_hash is not null").groupBy("url_hash").agg(F.max("captured_at").alias("updated_at"))
    start = s.sql(f"SELECT timestamp '{since}'").first()[0]
    return merge.after(seen.select("updated_at", "url_hash"), ["updated_at", "url_hash"], (start, ""), page).select("url_hash", "updated_at")


@query("full_outer_reconcile", "SELECT coalesce(r.k, e.k) AS k, r.k IS NULL AS only_events, e.k IS NULL AS only_records FROM (SELECT DISTINCT key AS k FROM records) r FULL OUTER JOIN (SELECT DISTINCT record_key AS k FROM capture_events) e ON r.k = e.k WHERE r.k IS NULL OR e.k IS NULL")
def reconcile(s, d):
    r, e = _t(s, d, "records", "capture_events")
    a, b = r.select(F.col("key").alias("a")).distinct(), e.select(F.col("record_key").alias("b")).distinct()
    return a.join(b, F.col("a") == F.col("b"), "full_outer").where("a is null or b is null").select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("only_events"), F.col("b").isNull().alias("only_records"))


@query("full_outer_extraction", "SELECT coalesce(r.k, o.k) AS k, r.k IS NULL AS only_observed, o.k IS NULL AS only_recorded, o.n AS observations FROM (SELECT DISTINCT key AS k FROM records) r FULL OUTER JOIN (SELECT record_key AS k, count(*) AS n FROM observations GROUP BY 1) o ON r.k = o.k")
def extraction_state(s, d):
    """Every record and every observed key, with its observations; many records have none yet."""
    r, o = _t(s, d, "records", "observations")
    a, b = r.select(F.col("key").alias("a")).distinct(), o.groupBy(F.col("record_key").alias("b")).agg(F.count("*").alias("observations"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("k"), F.col("a").isNull().alias("only_observed"), F.col("b").isNull().alias("only_recorded"), "observations")


# --- aggregates --------------------------------------------------------------------------------------------------


@query("a1_record_stats", "SELECT platform, record_type, count(*) AS n, count(*) FILTER (match_score > 0) AS matched, max(captured_at) AS newest FROM records GROUP BY platform, record_type")
def record_stats(s, d):
    (r,) = _t(s, d, "records")
    return r.groupBy("platform", "record_type").agg(F.count("*").alias("n"), F.count_if(F.col("match_score") > 0).alias("matched"), F.max("captured_at").alias("newest"))


@query("a2_top_containers", "SELECT platform, container_id, max(container_name) AS name, count(*) AS n, max(captured_at) AS newest FROM records WHERE match_score > 0 GROUP BY platform, container_id ORDER BY n DESC, container_id NULLS LAST, platform LIMIT 20")
def top_containers(s, d):
    (r,) = _t(s, d, "records")
    return r.where("match_score > 0").groupBy("platform", "container_id").agg(F.max("container_name").alias("name"), F.count("*").alias("n"), F.max("captured_at").alias("newest")).orderBy(F.col("n").desc(), F.col("container_id").asc_nulls_last(), "platform").limit(20)


@query("a3_multi_context", "SELECT record_key, count(DISTINCT context) AS contexts FROM capture_events GROUP BY record_key HAVING count(DISTINCT context) > 1")
def multi_context(s, d):
    (e,) = _t(s, d, "capture_events")
    return e.select("record_key", "context").distinct().groupBy("record_key").agg(F.count("context").alias("contexts")).where("contexts > 1")


@query("a4_coverage", "SELECT platform, count(*) AS n, round(avg(CASE WHEN payload_hash IS NULL THEN 0 ELSE 1 END), 4) AS payloads, round(avg(CASE WHEN content_hash IS NULL THEN 0 ELSE 1 END), 4) AS contents FROM records GROUP BY platform")
def coverage(s, d):
    (r,) = _t(s, d, "records")
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 4)
    return r.groupBy("platform").agg(F.count("*").alias("n"), share("payload_hash").alias("payloads"), share("content_hash").alias("contents"))


@query("a5_class_histogram", "SELECT signal_class, asset_type, count(*) AS n, round(avg(signal_confidence), 6) AS confidence FROM observations GROUP BY ALL")
def class_histogram(s, d):
    (o,) = _t(s, d, "observations")
    return o.groupBy("signal_class", "asset_type").agg(F.count("*").alias("n"), F.round(F.avg("signal_confidence"), 6).alias("confidence"))


@query("a6_location_stats", "SELECT precision, count(*) AS n, count(*) FILTER (lat IS NOT NULL) AS with_point, count(*) FILTER (list_bool_or(list_transform(signals, lambda x: x LIKE '%ambiguous%'))) AS ambiguous FROM resolved_locations GROUP BY precision")
def location_stats(s, d):
    (l,) = _t(s, d, "resolved_locations")
    return l.groupBy("precision").agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNotNull()).alias("with_point"), F.count_if(F.exists("signals", lambda x: x.like("%ambiguous%"))).alias("ambiguous"))


@query("a9_amount_statistics", """
    SELECT asset_type, currency_original, price_basis, count(*) AS n, min(amount) AS least, max(amount) AS greatest, round(median(amount), 2) AS median, arg_max(amount, (observed_at, price_observation_id)) AS latest
    FROM (SELECT DISTINCT p.price_observation_id, o.asset_type, currency_original, price_basis, cast(amount_original AS double) AS amount, p.observed_at FROM price_observations p JOIN observations o USING (observation_id)) GROUP BY ALL""")
def amount_statistics(s, d):
    """Least, greatest, exact median and latest amount per asset type, currency and basis."""
    p, o = _t(s, d, "price_observations", "observations")
    rows = p.join(o.select("observation_id", "asset_type"), "observation_id").select("price_observation_id", "asset_type", "currency_original", "price_basis", F.col("amount_original").cast("double").alias("amount"), "observed_at").distinct()
    by = ["asset_type", "currency_original", "price_basis"]
    rows = cut(rows)
    simple = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("amount").alias("least"), F.max("amount").alias("greatest"), F.max_by("amount", F.struct("observed_at", "price_observation_id")).alias("latest"))
    middle = exact_quantile(rows, by, "amount", 0.5, "median").select(*(F.col(c).alias(f"_{c}") for c in by), F.round("median", 2).alias("median"))
    return simple.join(middle, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*(f"_{c}" for c in by))


@query("a13_p95_delay", "SELECT ingest_source, round(quantile_cont(epoch(e.captured_at - r.first), 0.95), 3) AS p95 FROM capture_events e JOIN (SELECT record_key, min(captured_at) AS first FROM capture_events GROUP BY 1) r USING (record_key) GROUP BY 1")
def p95_delay(s, d):
    (e,) = _t(s, d, "capture_events")
    first = e.groupBy("record_key").agg(F.min("captured_at").alias("first"))
    late = (F.unix_micros("captured_at") - F.unix_micros("first")) / 1e6
    delays = e.join(first, "record_key").select("ingest_source", late.alias("late"))
    return exact_quantile(delays, ["ingest_source"], "late", 0.95, "p95").select("ingest_source", F.round("p95", 3).alias("p95"))


@query("a16_rules_of_records", "SELECT record_a, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules, count(*) AS edges FROM cluster_edges WHERE record_a IS NOT NULL GROUP BY record_a")
def rules_of_records(s, d):
    (e,) = _t(s, d, "cluster_edges")
    return e.where("record_a is not null").groupBy("record_a").agg(F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"), F.count("*").alias("edges"))


@query("a19_ages", "SELECT CASE WHEN age < 30 THEN 'active' WHEN age < 90 THEN 'aging' WHEN age < 180 THEN 'stale' ELSE 'dormant' END AS stage, count(*) AS n FROM (SELECT record_key, date_diff('day', cast(max(captured_at) AS date), DATE '2026-09-01') AS age FROM capture_events GROUP BY 1) GROUP BY 1")
def ages(s, d):
    (e,) = _t(s, d, "capture_events")
    age = F.datediff(F.lit("2026-09-01").cast("date"), F.to_date(F.max("captured_at")))
    stage = F.when(F.col("age") < 30, "active").when(F.col("age") < 90, "aging").when(F.col("age") < 180, "stale").otherwise("dormant")
    return e.groupBy("record_key").agg(age.alias("age")).groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


@query("a21_fill_rates", "SELECT platform, round(avg(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE 1 END), 4) AS text, round(avg(CASE WHEN author_name IS NULL THEN 0 ELSE 1 END), 4) AS author, round(avg(CASE WHEN len(media) > 0 THEN 1 ELSE 0 END), 4) AS media FROM records GROUP BY platform")
def fill_rates(s, d):
    (r,) = _t(s, d, "records")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    return r.groupBy("platform").agg(share(F.col("text") != "").alias("text"), share(F.col("author_name").isNotNull()).alias("author"), share(F.size("media") > 0).alias("media"))


@query("cube_observations", "SELECT signal_class, asset_type, grouping(signal_class) AS all_classes, grouping(asset_type) AS all_types, count(*) AS n FROM observations GROUP BY CUBE (signal_class, asset_type)")
def cube_observations(s, d):
    (o,) = _t(s, d, "observations")
    return o.cube("signal_class", "asset_type").agg(F.grouping("signal_class").cast("long").alias("all_classes"), F.grouping("asset_type").cast("long").alias("all_types"), F.count("*").alias("n"))


@query("rollup_places", "SELECT province_code, district_code, count(*) AS n FROM resolved_locations GROUP BY ROLLUP (province_code, district_code)")
def rollup_places(s, d):
    (l,) = _t(s, d, "resolved_locations")
    return l.rollup("province_code", "district_code").agg(F.count("*").alias("n"))


@query("set_operations", """
    SELECT 'both' AS part, count(*) AS n FROM (SELECT key FROM records INTERSECT SELECT record_key FROM capture_events) UNION ALL SELECT 'either', count(*) FROM (SELECT key FROM records UNION SELECT record_key FROM capture_events)
    UNION ALL SELECT 'first only', count(*) FROM (SELECT key FROM records EXCEPT SELECT record_key FROM capture_events)""")
def set_operations(s, d):
    r, e = _t(s, d, "records", "capture_events")
    a, b = r.select("key"), e.select(F.col("record_key").alias("key"))
    part = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return part(a.intersect(b), "both").unionByName(part(a.union(b).distinct(), "either")).unionByName(part(a.subtract(b), "first only"))


# --- text, hashes, addresses -------------------------------------------------------------------------------------


@query("x3_ascii_digits", "SELECT claim_id, translate(value_text, '໐໑໒໓໔໕໖໗໘໙๐๑๒๓๔๕๖๗๘๙', '01234567890123456789') AS t FROM (SELECT DISTINCT claim_id, value_text FROM claims WHERE field <> 'CONTACT')")
def digits_folded(s, d):
    (c,) = _t(s, d, "claims")
    return c.where("field <> 'CONTACT'").select("claim_id", "value_text").distinct().select("claim_id", F.translate("value_text", x.LAO_THAI_DIGITS, "0123456789" * 2).alias("t"))


@query("x7_hashtags", "SELECT tag, count(*) AS n FROM (SELECT DISTINCT key, unnest(regexp_extract_all(text, '#[\\p{L}\\p{M}\\p{N}_]+')) AS tag FROM records) GROUP BY tag")
def hashtags(s, d):
    (r,) = _t(s, d, "records")
    tags = r.select("key", F.explode(F.regexp_extract_all("text", F.lit(r"(#[\p{L}\p{M}\p{N}_]+)"))).alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count("*").alias("n"))


@query("x9_same_bare_text", """
    WITH b AS (SELECT DISTINCT key, regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM records WHERE text IS NOT NULL)
    SELECT key, min(key) OVER (PARTITION BY t) AS first, count(*) OVER (PARTITION BY t) AS copies FROM b""")
def same_bare_text(s, d):
    """Records whose letters and digits are the same, each with the first of its group; digests are shuffled, not texts."""
    (r,) = _t(s, d, "records")
    t = F.regexp_replace(F.regexp_replace(F.lower("text"), x.URL, " "), r"[^\p{L}\p{N}]+", "")
    rows = r.where("text is not null").select("key", F.sha2(t, 256).alias("h")).distinct()
    per = rows.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("copies"))
    return rows.join(per, "h").select("key", "first", "copies")


@query("x11_comment_like_post", """
    WITH g AS (SELECT key, record_type, platform, post_id, parent_post_id, CASE WHEN length(t) > 0 THEN list_distinct(list_transform(range(1, greatest(length(t) - 2, 1) + 1), lambda i: substring(t, i, 3))) ELSE [] END AS g
               FROM (SELECT DISTINCT key, record_type, platform, post_id, parent_post_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM records WHERE text IS NOT NULL))
    SELECT c.key AS comment, p.key AS post, CASE WHEN len(c.g) > 0 AND len(p.g) > 0 THEN round(len(list_intersect(c.g, p.g)) / len(list_distinct(list_concat(c.g, p.g))), 6) ELSE 0.0 END AS jaccard
    FROM g c JOIN g p ON p.record_type = 'post' AND c.record_type = 'comment' AND c.parent_post_id = p.post_id AND c.platform = p.platform""")
def comment_like_post(s, d):
    """Likeness of comments to their posts by character trigrams."""
    (r,) = _t(s, d, "records")
    made = r.where("text is not null").select("key", "record_type", "platform", "post_id", "parent_post_id", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "").alias("t")).distinct()
    c, p = made.where("record_type = 'comment'"), made.where("record_type = 'post'")
    # Texts are moved, not their trigrams, which are several times as large; these are cut in one Arrow pass afterwards.
    both = c.select(F.col("key").alias("comment"), "platform", F.col("parent_post_id").alias("post_id"), F.col("t").alias("tc")).join(p.select(F.col("key").alias("post"), "platform", "post_id", F.col("t").alias("tp")), ["platform", "post_id"])
    return both.select("comment", "post", F.round(x.gram_jaccard("tc", "tp"), 6).alias("jaccard"))


@query("x14_masked_contacts", "SELECT DISTINCT claim_id, CASE WHEN length(value_text) > 6 THEN substring(value_text, 1, 4) || repeat('X', length(value_text) - 6) || right(value_text, 2) ELSE repeat('X', length(value_text)) END AS mask FROM claims WHERE field = 'CONTACT' AND value_text IS NOT NULL")
def masked_contacts(s, d):
    (c,) = _t(s, d, "claims")
    return c.where("field = 'CONTACT' and value_text is not null").select("claim_id", x.masked(F.col("value_text")).alias("mask")).distinct()


@query("x15_truncated", None)
def truncated(s, d, most=300):
    """Texts cut to a number of UTF-8 bytes without splitting a sign."""
    (docs,) = _t(s, d, "documents")
    return docs.select("doc_id", x.truncated(F.col("text"), most).alias("text"))


@query("x16_leak_scan", "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS email, regexp_matches(text, 'https?://\\S+') AS address, regexp_matches(text, '\\b[0-9a-f]{64}\\b') AS digest FROM documents")
def leak_scan(s, d):
    (docs,) = _t(s, d, "documents")
    return docs.select("doc_id", F.col("text").rlike(x.EMAIL).alias("email"), F.col("text").rlike(x.URL).alias("address"), F.col("text").rlike(r"\b[0-9a-f]{64}\b").alias("digest"))


@query("x22_simhash", None)
def simhashes(s, d):
    """SimHash of every document's letters and digits by trigrams."""
    (docs,) = _t(s, d, "documents")
    return docs.select("doc_id", x.simhash(x.bare(F.col("text"))).alias("simhash"))


@query("j13_similar_records", None)
def similar_records(s, d):
    """Classes of records whose texts are alike, with copies and links; not pairs of copies."""
    (r,) = _t(s, d, "records")
    return similar.similar_texts(r.select("key", "text").distinct(), "key", "text")


@query("content_hashes", "SELECT doc_id, sha256(array_to_string([source, doc_type, nfc_normalize(text), coalesce(strftime(collected_at, '%Y-%m-%d'), '')], chr(31))) AS digest FROM documents")
def content_hashes(s, d):
    """SHA-256 over the fields of a document's content, apart from how often it was seen."""
    (docs,) = _t(s, d, "documents")
    return docs.select("doc_id", F.sha2(F.concat_ws(chr(31), F.coalesce("source", F.lit("")), F.coalesce("doc_type", F.lit("")), F.coalesce(x.composed("text"), F.lit("")), F.coalesce(F.date_format("collected_at", "yyyy-MM-dd"), F.lit(""))), 256).alias("digest"))


@query("r9_page_addresses", "SELECT key, CASE WHEN regexp_matches(permalink, '^https?://[^/?#]+') THEN 'https://' || lower(regexp_extract(permalink, '^https?://([^/?#]*)', 1)) || regexp_replace(regexp_extract(permalink, '^https?://[^/?#]*([^?#]*)', 1) || '/', '/+$', '/') ELSE permalink END AS address FROM records WHERE permalink IS NOT NULL")
def page_addresses(s, d):
    (r,) = _t(s, d, "records")
    return r.where("permalink is not null").select("key", urls.page_address(F.col("permalink")).alias("address"))


@query("sighting_contexts", "SELECT key, CASE WHEN coalesce(container_id, '') <> '' THEN 'container:' || container_id WHEN permalink IS NULL THEN 'page:unknown' ELSE 'page:' || regexp_replace(lower(regexp_extract(permalink, '^https?://([^/?#]+)', 1)), '^(www|m|mbasic|web)\\.', '') || regexp_replace(regexp_extract(permalink, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') END AS context FROM records")
def sighting_contexts(s, d):
    (r,) = _t(s, d, "records")
    return r.select("key", urls.sighting_context(F.col("permalink"), F.col("container_id")).alias("context"))


@query("s11_parsed_payloads", "SELECT key, post_id, text, reactions_total, comments_count FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY captured_at, payload_hash) AS n FROM records WHERE platform = 'tiktok' AND record_type = 'post' AND text <> '') WHERE n = 1")
def parsed_payloads(s, d):
    """Item-list payloads written from the records and parsed back."""
    from tamarind.sources.payloads import parsed_records

    (r,) = _t(s, d, "records")
    one = merge.latest(r.where("platform = 'tiktok' and record_type = 'post' and text <> ''"), ["key"], [F.col("captured_at"), F.col("payload_hash")])
    stats = F.struct(F.col("reactions_total").alias("diggCount"), F.col("comments_count").alias("commentCount"))
    item = F.struct(F.regexp_replace("key", "^tiktok:", "").alias("id"), F.col("text").alias("desc"), F.struct(F.col("author_id").alias("id")).alias("author"), stats.alias("stats"))
    raw = one.select(F.to_json(F.struct(F.array(item).alias("itemList"))).alias("body"), F.lit("https://www.tiktok.com/tag/land").alias("page_url"))
    return parsed_records(raw).select("key", "post_id", "text", "reactions_total", "comments_count")


@query("s11_parsed_feed", "SELECT 'facebook:' || post_id AS key, text, reactions_total, comments_count, shares_count, container_id FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY captured_at, payload_hash, key) AS n FROM records WHERE post_id <> '' AND text <> '') WHERE n = 1")
def parsed_feed(s, d):
    """Feed payloads of stories written from the records of all platforms and parsed back."""
    from tamarind.sources.payloads import parsed_records

    (r,) = _t(s, d, "records")
    one = merge.latest(r.where("post_id <> '' and text <> ''"), ["post_id"], [F.col("captured_at"), F.col("payload_hash"), F.col("key")])
    named = lambda **x: F.struct(*(c.alias(n) for n, c in x.items()))
    feedback = named(reaction_count=named(count=F.col("reactions_total")), comment_rendering_instance=named(comments=named(total_count=F.col("comments_count"))), share_count=named(count=F.col("shares_count")))
    story = named(__typename=F.lit("Story"), post_id=F.col("post_id"), message=named(text=F.col("text")), to=named(__typename=F.lit("Group"), id=F.col("container_id")), feedback=feedback)
    raw = one.select(F.to_json(named(data=named(node=story))).alias("body"), F.lit("https://www.facebook.com/groups/feed/").alias("page_url"))
    return parsed_records(raw).select("key", "text", "reactions_total", "comments_count", "shares_count", "container_id")


# --- event time --------------------------------------------------------------------------------------------------


@query("tumbling_events", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def tumbling_events(s, d):
    (e,) = _t(s, d, "events")
    return capture.windows(e, "ts", "1 hour", by=("event_type",), value="value")


@query("sliding_sightings", "SELECT w AS window_start, w + INTERVAL 1 day AS window_end, ingest_source, count(*) AS n FROM (SELECT ingest_source, unnest([time_bucket(INTERVAL 12 hours, captured_at, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 hours, captured_at, TIMESTAMP '1970-01-01') - INTERVAL 12 hours]) AS w FROM (SELECT ingest_source, cast(captured_at AS timestamp) AS captured_at FROM capture_events WHERE captured_at IS NOT NULL)) GROUP BY ALL")
def sliding_sightings(s, d):
    (e,) = _t(s, d, "capture_events")
    return capture.windows(e, "captured_at", "1 day", "12 hours", by=("ingest_source",))


@query("sessions_of_users", """
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, count(*) AS n FROM (SELECT user_id, ts, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS g FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s""")
def sessions_of_users(s, d):
    (e,) = _t(s, d, "events")
    return capture.sessions(e, "ts", "30 minutes", ("user_id",))


# --- the star schema ---------------------------------------------------------------------------------------------


@query("q1_pricing_summary", """
    SELECT l_returnflag, l_linestatus, cast(sum(l_quantity) AS decimal(18,2)) AS sum_qty, cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS decimal(28,4)) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(s, d):
    (l,) = _t(s, d, "lineitem")
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return l.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp")).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("decimal(18,2)").alias("sum_qty"), F.sum(price).cast("decimal(28,4)").alias("revenue"), F.count("*").alias("n"))


@query("q5_region_volume", """
    SELECT n_name, cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS decimal(28,4)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def region_volume(s, d):
    l, o, c, su, n, r = _t(s, d, "lineitem", "orders", "customer", "supplier", "nation", "region")
    j = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(su, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).cast("decimal(28,4)").alias("revenue"))


@query("top_lines_per_order", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n <= 2")
def top_lines(s, d):
    (l,) = _t(s, d, "lineitem")
    return merge.latest(l, ["l_orderkey"], [F.col("l_extendedprice").desc(), F.col("l_linenumber")], 2).select("l_orderkey", "l_linenumber")
