import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tamarind.functions import geometry, text, urls
from tamarind.operators import joins, merge, similar
from tamarind.plans import relational
from tamarind.sources import files, payloads
from tamarind.streaming import capture

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


# --- addresses and text


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("http://m.facebook.com/groups/12/permalink/34/?fbclid=x", "https://www.facebook.com/groups/12/posts/34"), ("https://WWW.Site.com/a?b=2&a=1#f", "https://www.site.com/a/?a=1&b=2"), ("https://x.org", "https://x.org/?utm_source=q&__cft__[0]=z"),
    ],
)
def test_addresses_of_one_page(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(urls.page_address(F.col("a")).alias("a"), urls.page_address(F.col("b")).alias("b"))
    assert df.first()[0] == df.first()[1]


POSTS = [
    [f"https://www.facebook.com/groups/55/posts/901/{q}" for q in ("", "?fbclid=1", "?comment_id=4&notif_t=x")] + ["https://m.facebook.com/groups/55/permalink/901/?refid=1&__so__=2", "http://mbasic.facebook.com/groups/55/permalink/901/"],
    ["https://www.facebook.com/permalink.php?story_fbid=77&id=8", "https://m.facebook.com/story.php?id=8&mibextid=q&story_fbid=77"],
    ["https://www.facebook.com/shop/posts/31", "https://m.facebook.com/shop/posts/31/?locale=fr"],
    ["https://www.facebook.com/photo/?fbid=61&set=a", "https://m.facebook.com/photo.php?fbid=61&id=3"],
    ["https://www.facebook.com/watch/?v=12", "https://www.facebook.com/shop/videos/12/", "https://www.facebook.com/shop/videos/title/12/?x=1"],
    ["https://www.tiktok.com/@u/video/5", "https://m.tiktok.com/@u/video/5?_r=1"],
    ["https://www.facebook.com/share/p/Ab1/", "https://www.facebook.com/share/p/Ab1/?mibextid=x"], ["https://vt.tiktok.com/Zz1/", "https://vt.tiktok.com/Zz1?a=1"], ["https://www.facebook.com/shop/posts/pfbid0A/", "https://m.facebook.com/shop/posts/pfbid0A?x=1"],
]
NAMED = ["facebook:901", "facebook:77", "facebook:31", "facebook:61", "facebook:12", "tiktok:5", None, None, None]


def test_addresses_of_one_post(spark):
    df = spark.createDataFrame([(i, u) for i, group in enumerate(POSTS) for u in group], "i int, u string")
    got = df.select("i", urls.permalink(F.col("u")).alias("p"), urls.post_of(F.col("u")).alias("id")).collect()
    assert len({(r["i"], r["p"]) for r in got}) == len(POSTS) == len({r["p"] for r in got})
    assert {(r["i"], r["id"]) for r in got} == set(enumerate(NAMED))
    assert [r[0] for r in spark.createDataFrame([("https://a.b/c/d/",), ("https://a.b",)], "u string").select(urls.targets_of(F.col("u"))).collect()] == [["https://a.b", "https://a.b/c", "https://a.b/c/d"], ["https://a.b"]]


def test_utf16_slices(spark):
    rows = [("a🙏b ລາວ", 3, 4, "b"), ("🙏x", 0, 2, "🙏"), ("e\u0301x", 0, 1, "é"), ("abc", 1, 99, "bc"), ("abc", None, 2, None), (None, 0, 1, None), ("", 0, 5, "")]
    df = spark.createDataFrame([r[:3] for r in rows], "t string, a int, b int")
    assert [r[0] for r in df.select(text.utf16_slice("t", "a", "b")).collect()] == [r[3] for r in rows]


def test_pages_and_purges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "key string, t int")
    assert [r["key"] for r in merge.after(df, ["t", "key"], (2, "b"), 2).collect()] == ["c", "d"] and merge.after(df, ["t", "key"], None, 10).count() == 4
    with pytest.raises(ValueError):
        merge.after(df, ["t"], None, 0)
    stays, gone = merge.purged(df, "t", F.lit(3), df.where("key = 'b'"))
    assert sorted(r["key"] for r in stays.collect()) == ["b", "d"] and sorted(r["key"] for r in gone.collect()) == ["a", "c"]


def test_address_edges(spark):
    df = spark.createDataFrame([(" no address ", None), (None, "c1"), ("https://m.x.org/p/q/?a=1", ""), ("https://www.tiktok.com/@u/video/77?x=1", None)], "u string, c string")
    assert [r[0] for r in df.select(urls.page_address(F.col("u"))).collect()][:2] == ["no address", None]
    assert [r[0] for r in df.select(urls.sighting_context(F.col("u"), F.col("c"))).collect()] == ["page:unknown", "container:c1", "page:x.org/p/q", "page:tiktok.com/@u/video/77"]
    assert [r[0] for r in df.select(urls.post_of(F.col("u"))).collect()][3] == "tiktok:77"


def test_text(spark):
    df = spark.createDataFrame([("ໂທ ໐໒໐ ๕​x", "Straße É", "12345678"), (None, None, None), ("", "", "123")], "a string, b string, c string")
    got = df.select(text.ascii_digits(F.col("a")).alias("a"), text.folded("b").alias("b"), text.masked(F.col("c")).alias("m"), text.grams(F.col("c")).alias("g"), text.simhash(F.col("a")).alias("h")).collect()
    assert got[0]["a"] == "ໂທ 020 5 x" and got[0]["b"] == "strasse é" and got[0]["m"] == "1234XX78" and got[2]["m"] == "XXX" and got[1]["a"] is None
    assert got[0]["g"] == ["123", "234", "345", "456", "567", "678"] and got[2]["g"] == ["123"] and got[1]["h"] == 0
    assert spark.range(1).select(text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), text.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[:] == (0.5, 2 / 3)


def test_truncated_splits_no_sign(spark):
    texts = ["abc", "ລາວລາວ", "é" * 5, "🙏🙏", "", None, "aລ🙏"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in range(1, 12):
        want = [None if t is None else next(t[:n] for n in range(len(t), -1, -1) if len(t[:n].encode()) <= most) for t in texts]
        assert [r[0] for r in df.select(text.truncated(F.col("t"), most)).collect()] == want


def test_simhash_against_votes(spark):
    import hashlib

    t = "hello world of plots"
    votes = [0] * 64
    for g in {t[i : i + 3] for i in range(len(t) - 2)}:
        h = int.from_bytes(hashlib.sha256(g.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    want = sum(1 << i for i in range(64) if votes[i] > 0)
    got = spark.createDataFrame([(t,)], "t string").select(text.simhash(F.col("t"))).first()[0]
    assert got % (1 << 64) == want


# --- merges


def test_merge_policy(spark):
    rows = [("a", "t1", 5, [], at(1), at(1), "p1"), ("a", None, None, ["x"], at(3), at(2), "p2"), ("a", "t3", 2, None, None, at(0), "p3"), (None, "z", 1, [], at(1), at(1), "p")]
    df = spark.createDataFrame(rows, "key string, text string, match_score int, media array<string>, created_at timestamp, captured_at timestamp, payload_hash string")
    (got,) = merge.merged_records(df).collect()
    assert (got["text"], got["match_score"], got["media"], got["created_at"], got["captured_at"], got["payload_hash"], got["capture_count"], got["first_seen"]) == ("t1", 5, ["x"], at(1), at(2), "p2", 3, at(0))
    late = spark.createDataFrame([("a", "new", 1, ["y"], at(9), at(0), "p0")], df.schema)
    merged = merge.upserted(df, late).first()
    assert merged["text"] == "new" and merged["media"] == ["y"] and merged["match_score"] == 5
    assert merge.merged_records(df.limit(0)).count() == 0


def test_new_only_and_running_total(spark):
    e = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("b", "h", 3)], "k string, h string, id long")
    assert [r["id"] for r in merge.new_only(e.where("id = 3"), e, ["k", "h"], ["id"]).collect()] == [1]
    r = random.Random(1)
    v = [(i, r.randint(0, 9)) for i in r.sample(range(10_000), 500)] + [(20_000, None)]
    total, want = 0, {}
    for i, n in sorted(v):
        total += n or 0
        want[i] = total
    assert {x["i"]: x["running"] for x in merge.running_total(spark.createDataFrame(v, "i long, v long"), "i", "v", 64).collect()} == want


EVENTS = [(1, "a", "h1", "c1", at(0)), (2, "a", "h1", "c1", at(1)), (3, "a", "h1", "c2", at(2)), (4, "a", "h2", "c1", at(3)), (5, "a", "h2", "c1", at(4)), (6, "a", None, "c1", at(5)), (7, "a", "h2", "c3", at(6)), (8, "b", "h1", "c1", at(1))]
DECIDED = {1: "new", 2: "repeat", 3: "new_context", 4: "changed", 5: "repeat", 6: "changed", 7: "changed", 8: "new"}
EVENT = "id long, record_key string, payload_hash string, context string, captured_at timestamp"


def test_sightings(spark):
    assert {r["id"]: r["decision"] for r in merge.sightings(spark.createDataFrame(EVENTS, EVENT)).collect()} == DECIDED


def test_sightings_on_a_stream(spark, tmp_path):
    for i, part in enumerate((EVENTS[:3], EVENTS[3:])):
        spark.createDataFrame(part, EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}.parquet"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = capture.stateful_sightings(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["record_key"], r["captured_at"]): r["decision"] for r in spark.table("decided").collect()}
    assert got == {(k, t): DECIDED[i] for i, k, _, _, t in EVENTS}


def test_windows_on_a_stream_are_those_of_the_table(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = capture.windows(stream, "ts", "1 hour", by=("event_type",), late="10 minutes").writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {tuple(r) for r in capture.windows(events, "ts", "1 hour", by=("event_type",)).collect()}
    assert {tuple(r) for r in spark.table("hours").collect()} == want
    assert capture.once(events.unionAll(events), ["event_id"], "ts", "1 hour").count() == events.count()


def test_merge_into_versions(spark, tmp_path):
    schema = "key string, platform string, text string, captured_at timestamp, payload_hash string, match_score int, extra string"
    rows = [("a", "p", "1", at(5), "x", 1, None), ("a", None, "2", at(6), "y", 3, "e"), ("b", "q", "3", at(7), "z", 1, None), ("a", "p", None, at(8), "w", 2, None)]
    frames = [spark.createDataFrame(part, schema) for part in (rows[:1], rows[1:3], rows[3:])]
    apply = capture.merge_into(str(tmp_path / "t"))
    for part, number in zip(frames, (0, 1, 5)):  # a gap before the last
        apply(part, number)
    apply(frames[1], 1)  # a batch that comes again
    got = {r["key"]: r.asDict() for r in spark.read.parquet(str(tmp_path / "t" / "batch=5")).collect()}
    assert got == {r["key"]: r.asDict() for r in merge.merged_records(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"] == {"key": "a", "platform": "p", "text": "2", "captured_at": at(8), "payload_hash": "w", "match_score": 3, "extra": "e", "capture_count": 3, "first_seen": at(5), "first_payload_hash": "x"}
    for number in (6, 7, 8):
        apply(frames[0].limit(0), number)
    assert sorted(p.name for p in (tmp_path / "t").glob("batch=*")) == ["batch=5", "batch=6", "batch=7", "batch=8"]


def test_appends_and_states(spark):
    s = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "k int, v string, w string")
    a = spark.createDataFrame([(2, None, "x"), (3, "d", None), (4, "e", "z"), (4, "e", "z")], "k int, v string, w string")
    assert sorted((r["k"], r["v"]) for r in merge.appended(s, a, ["k"], ["v"]).collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "e")]
    assert {tuple(r) for r in merge.merged_state(s, a.distinct(), ["k"]).collect()} == {(1, "a", None, "missing"), (2, "b", "x", "kept"), (3, "d", "y", "updated"), (4, "e", "z", "inserted")}


# --- joins


def test_asof(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    left = spark.createDataFrame([(1, "A", day(9)), (2, "A", day(3)), (3, "A", day(30)), (4, "B", day(9)), (5, None, day(9)), (6, "A", None)], "id int, c string, d date")
    right = spark.createDataFrame([("A", day(0), 1.0), ("A", day(8), 2.0), ("A", day(9), 3.0), ("A", None, 9.0)], "c string, rd date, v double")
    assert {r["id"]: r["v"] for r in joins.asof(left, right, "c", "d", "rd", "v").collect()} == {1: 3.0, 2: 1.0, 3: None, 4: None, 5: None, 6: None}


def test_near_pairs_against_brute_force(spark):
    r = random.Random(4)
    pts = [(i, r.uniform(17.9, 18.1), r.uniform(102.4, 102.6)) for i in range(300)] + [(900, None, 1.0), (901, 18.0, 102.5), (902, 18.0, 102.5)]
    got = {(x["a"], x["b"]) for x in joins.near_pairs(spark.createDataFrame(pts, "k long, y double, x double"), "k", "y", "x", 1500).collect()}
    real = [p for p in pts if p[1] is not None]
    assert got == {(a[0], b[0]) for a in real for b in real if a[0] < b[0] and geometry.haversine_m(a[1], a[2], b[1], b[2]) <= 1500}


def test_similar_names_at_the_very_bound(spark):
    """Seven letter pairs against three of them score exactly 0.6, whichever of them are rare."""
    names = ["abcdefgh", "abcd", "bcde", "cdef", "defg", "efgh"]
    left = spark.createDataFrame([(0, names[0])], "k int, n string")
    for rare in range(1, 6):
        others = [(10 + i, n) for i, n in enumerate(names[1:], 1)] + [(100 + 10 * i + j, n[:2] + "xyz"[j % 3] * 7) for i, n in enumerate(names[1:], 1) if i != rare for j in range(3)]
        got = {r["b"] for r in joins.similar_names(left, spark.createDataFrame(others, "k int, n string"), "k", "n").collect()}
        assert set(range(11, 16)) <= got


def test_location_texts_are_looked_up(spark, tmp_path):
    spark.createDataFrame([("LOCATION_TEXT", "Phonxai"), ("LOCATION_TEXT", "Phonxai"), ("PRICE", "Phonxay"), ("LOCATION_TEXT", None)], "field string, value_text string").write.parquet(f"{tmp_path}/claims.parquet")
    place = "code string, name_lo string, name_en string, name_variants array<string>"
    spark.createDataFrame([("V1", "ໂພນໄຊ", "Phonxay", None), ("V2", "ວຽງ", "Vieng", ["Phonxai"])], place).write.parquet(f"{tmp_path}/villages.parquet")
    spark.createDataFrame([("D1", "ໄຊ", "Phonxa", [])], place).write.parquet(f"{tmp_path}/districts.parquet")
    got = {tuple(x) for x in relational.QUERIES["j15_similar_places"](spark, str(tmp_path)).select("text", "level", "code", "score", "rank").collect()}
    assert got == {("Phonxai", "village", "V2", 1.0, 1), ("Phonxai", "village", "V1", 0.833333, 2), ("Phonxai", "district", "D1", 0.909091, 1)}


def test_near_pairs_of_crowds(spark):
    r = random.Random(5)
    crowd = [(i, 18.0 + r.gauss(0, 0.0004), 102.5 + r.gauss(0, 0.0004)) for i in range(250)]
    copies = [(1000 + i, *crowd[i % 3][1:]) for i in range(40)]
    df = spark.createDataFrame(crowd + copies + [(2000, None, 102.5)], "k long, lat double, lng double")
    members = joins.same_points(df, "k", "lat", "lng").collect()
    assert len(members) == 290 and {m["k"]: m["point"] for m in members}[1004] == 1 and {m["copies"] for m in members} == {1, 14, 15}
    got = {(x["a"], x["b"]) for x in joins.near_pairs(spark.createDataFrame(crowd, "k long, lat double, lng double"), "k", "lat", "lng", 60, hot=7).collect()}
    assert got == {(a[0], b[0]) for a in crowd for b in crowd if a[0] < b[0] and geometry.haversine_m(a[1], a[2], b[1], b[2]) <= 60}


def test_near_observations_of_a_crowd(spark, tmp_path):
    """Locations round one village are linked by point; equal points are one with its members."""
    rows = [(1, 10, 18.0, 102.5, "VILLAGE"), (2, 11, 18.0, 102.5, "VILLAGE"), (3, 12, 18.001, 102.5, "EXACT_COORDINATE"), (4, 12, 18.002, 102.5, "PARCEL_APPROXIMATE"), (5, 13, 18.1, 102.5, None), (6, 14, None, None, "TEXT_ONLY")]
    spark.createDataFrame(rows, "resolved_location_id long, observation_id long, lat double, lng double, precision string").write.parquet(f"{tmp_path}/resolved_locations.parquet")
    links = {tuple(x) for x in relational.QUERIES["j12_near_points"](spark, str(tmp_path)).select("a", "b", "precise").collect()}
    assert links == {(1, 3, False), (3, 4, True), (1, 4, False)}
    members = {tuple(x) for x in relational.QUERIES["j12_point_members"](spark, str(tmp_path)).collect()}
    assert members == {(1, 10, 1, 2, False), (2, 11, 1, 2, False), (3, 12, 3, 1, True), (4, 12, 4, 1, True), (5, 13, 5, 1, False)}


def test_similar_names_and_walk(spark):
    names = ["Phonxay", "Phonsay", "Ponxay", "Vieng", "Viengkham", "V", "", None, "Nongbone", "Nong Bone"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    pairs = lambda s: {s[i : i + 2] for i in range(max(1, len(s) - 1))}
    flat = {k: pairs(n.lower().replace(" ", "")) for k, n in enumerate(names) if n}
    want = {(a, b) for a in flat for b in flat if 2 * len(flat[a] & flat[b]) / (len(flat[a]) + len(flat[b])) >= 0.6}
    assert {(r["a"], r["b"]) for r in joins.similar_names(df, df, "k", "n").collect()} == want
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["node"], r["distance"]) for r in joins.walk(edges, spark.createDataFrame([("a",)], "node string"), 9).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_lineage_walks_both_ways(spark, tmp_path):
    rows = {
        "records": ("key string, payload_hash string", [("f:1", "p1"), ("f:2", None)]), "capture_events": ("record_key string, payload_hash string", [("f:1", "p2"), ("f:1", "p1"), ("f:2", "p2")]), "observations": ("observation_id long, record_key string", [(7, "f:1")]),
        "claims": ("claim_id long, observation_id long", [(8, 7)]), "price_observations": ("price_observation_id long, claim_id long", [(9, 8)]), "resolved_locations": ("resolved_location_id long, observation_id long", [(5, 7), (6, 7)]), "cluster_edges": ("cluster_id string, record_a string, record_b string", [("C", "f:1", "f:2")]),
    }
    for name, (schema, made) in rows.items():
        spark.createDataFrame(made, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {tuple(x) for x in relational.QUERIES["j20_lineage_both"](spark, str(tmp_path)).collect()}
    of = lambda start, way: {x[2:] for x in got if x[:2] == (start, way)}
    assert of("record:f:1", "down") == {(1, "obs", 1), (1, "cluster", 1), (2, "claim", 1), (2, "loc", 2), (3, "price", 1)} and of("record:f:1", "up") == {(1, "payload", 2)}
    assert of("price:9", "up") == {(1, "claim", 1), (2, "obs", 1), (3, "record", 1), (4, "payload", 2)} and of("cluster:C", "up") == {(1, "record", 2), (2, "payload", 2)}
    assert of("payload:p2", "down") == {(1, "record", 2), (2, "obs", 1), (2, "cluster", 1), (3, "claim", 1), (3, "loc", 2), (4, "price", 1)}


def test_simhash_links_lose_no_pair(spark):
    r = random.Random(6)
    base = [r.getrandbits(64) for _ in range(40)]
    hashes = set(base)
    for h in base:
        for n in (1, 2, 3, 4):
            for b in r.sample(range(64), n):
                h ^= 1 << b
            hashes.add(h)
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    got = {(x["a"], x["b"]) for x in similar.simhash_links(spark.createDataFrame([(h,) for h in signed], "h long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 3}


def test_similar_texts(spark):
    long = "Owner selling farm land at Ban Phonxay with water and power close to the main road and a school nearby "
    rows = [("k1", long), ("k2", long.upper() + "!"), ("k3", long), ("k4", "another thing altogether about fish"), ("k5", None), ("k6", "!!"), (None, long)]
    got = {r["key"]: (r["class_key"], r["copies"]) for r in similar.similar_texts(spark.createDataFrame(rows, "key string, text string"), "key", "text").collect()}
    assert got == {"k1": ("k1", 3), "k2": ("k1", 3), "k3": ("k1", 3), "k4": ("k4", 1), "k5": ("k5", 1), "k6": ("k6", 1)}


def test_pushes_take_every_row(spark):
    r = random.Random(8)
    rows = [(f"k{i}", r.choice("abc"), at(r.randrange(400)), r.choice([5, 30, 80, 300])) for i in range(500)] + [("z", "d", at(1), 101), ("y", "a", at(2), None)]
    want = {}
    for q in "abcd":
        push, n, running = 0, 0, 0
        for k, _, t, b in sorted((x for x in rows if x[1] == q and x[3] is not None), key=lambda x: (x[2], x[0])):
            if b > 100:
                want[k] = (None, None, True, t)
                continue
            if not push or n == 4 or running + b > 100:
                push, n, running = push + 1, 0, 0
            n, running = n + 1, running + b
            want[k] = (push, running, False, t)
    df = spark.createDataFrame(rows, "k string, q string, t timestamp, b long")
    got = {x["k"]: (x["push"], x["running"], x["too_large"], x["t"]) for x in merge.pushes(df, "q", ["t", "k"], "b", 100, 4).collect()}
    assert got == want and len(got) == 501


def test_push_query_leaves_no_row_without_a_place(spark, sf_dir):
    df = relational.QUERIES["k3_pushes"](spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/records.parquet").where("text is not null and container_id is not null")
    assert df.where("push is not null or too_large").count() == rows.count()
    assert not df.where("too_large").count()
    assert df.groupBy("container_id", "push").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).where("n > 25 or b > 4000000").count() == 0


# --- sources and sinks

STORY = {"__typename": "Story", "post_id": "11", "wwwURL": "https://f.example/11", "creation_time": 1700000000, "actors": [{"id": "u1", "name": "Noy"}], "to": {"__typename": "Group", "id": "g1", "name": "Plots"},
         "message": {"text": "Land for sale #ຂາຍດິນ #land #land"}, "feedback": {"reaction_count": {"count": 42}, "comment_count": {"total_count": "7"}}, "attachments": [{"media": {"__typename": "Photo", "image": {"uri": "u"}}}, {"media": {"__typename": "Photo", "image": {"uri": "u"}}}]}


def test_feed_payload():
    later = {"data": {"__typename": "Story", "post_id": "11", "feedback": {"reaction_count": {"count": 45}}}}
    comment = {"__typename": "Comment", "id": "c9", "legacy_fbid": "99", "body": {"text": "How much?"}, "author": {"id": "u2", "name": "Keo"}}
    body = json.dumps({"data": [STORY]}) + "\n" + "not json\n" + json.dumps(later) + "\n" + json.dumps({"x": [comment, {"__typename": "Story", "post_id": "12"}]})
    post, reply = payloads.feed_records(body, "https://www.facebook.com/groups/feed/")
    assert (post["key"], post["reactions_total"], post["comments_count"], post["shares_count"], post["container_id"], post["media"], post["hashtags"], post["author_id"]) == ("facebook:11", 42, 7, None, "g1", ["u"], ["ຂາຍດິນ", "land"], "u1")
    assert (reply["key"], reply["parent_post_id"], reply["text"]) == ("facebook:99", "12", "How much?")
    for broken in ("", "{", "[]", "null", "[[[]]]", '{"__typename":"Story"}', "x\ny", None):
        assert payloads.feed_records(broken, None) == [] and payloads.video_records(broken, None) == []


def test_parsed_records(spark):
    item = {"itemList": [{"id": "7", "desc": "x #a", "createTime": "1700000000", "author": {"id": "1", "uniqueId": "u"}, "stats": {"diggCount": 5}, "video": {"playAddr": "v"}, "textExtra": [{"hashtagName": "b"}]}], "comments": [{"cid": "8", "text": "hi", "user": {"uid": "2"}, "aweme_id": "7"}]}
    df = spark.createDataFrame([(json.dumps(item), "https://www.tiktok.com/tag/a%20b", 1), (json.dumps(STORY), "https://www.facebook.com/groups/g/", 2), ("{", "https://www.facebook.com/x", 3), (None, "https://www.facebook.com/x", 4), ("{}", "https://else.example/", 5)], "body string, page_url string, platform int")
    got = {r["key"]: r for r in payloads.parsed_records(df).collect()}
    assert set(got) == {"tiktok:7", "tiktok:8", "facebook:11"}
    assert got["tiktok:7"]["container_id"] == "tag:a b" and got["tiktok:7"]["hashtags"] == ["b"] and got["tiktok:8"]["parent_post_id"] == "7" and got["tiktok:7"]["created_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)


def test_batches_quarantine(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"source": "s", "version": "1", "new": 1, "records": [{"key": "k", "platform": "p", "post_id": "1", "extra": {}}, {"key": "q"}]}) + "\n{broken\n")
    got = [(r["key"], r["reason"]) for r in files.read_batches(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([("k", None), ("q", "no identity"), (None, "broken")], key=repr)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", ['x"y'], None), ("ລາວ", [], 2)], "t string, l array<string>, n int").coalesce(1)
    files.write_csv(df, str(tmp_path / "csv"))
    raw = next(Path(tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbft,l,n\r\n") and raw.decode("utf-8-sig").split("\r\n")[1:3] == ['"a,b","[""x\\""y""]",', "ລາວ,[],2"]
    files.write_ndjson(df, str(tmp_path / "nd"), newest="n", limit=1)
    assert spark.read.json(str(tmp_path / "nd")).first()["t"] == "ລາວ"
    files.write_version(df.withColumn("admin_version", F.lit("v1")), str(tmp_path / "v"), "v1")
    with pytest.raises(ValueError):
        files.write_version(df, str(tmp_path / "v"), "v1")
    geo = json.dumps({"features": [{"properties": {"code": "A", "name": "x"}, "geometry": {"type": "Point"}}, {"properties": {}}]})
    assert [tuple(r) for r in files.geojson_units(spark.createDataFrame([(geo,), (None,)], "geojson string")).collect()] == [("A", "x", '{"type":"Point"}')]


def test_verified_bodies(spark):
    df = spark.createDataFrame([("abc", "BA7816BF8F01CFEA414140DE5DAE2223B00361A396177A9CB410FF61F20015AD"), ("abc", "0"), (None, "0"), ("x" * 99, "0")], "body string, payload_hash string")
    assert [r["status"] for r in payloads.verified(df, cap=50).collect()] == ["accepted", "hash differs", "missing", "too large"]
