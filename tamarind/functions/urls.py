"""Web addresses: one form for addresses of the same page, built from JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that never say which page is meant, by name and by beginning.
TRACKING = "fbclid mibextid rdid paipv notif_t notif_id ref refid refsrc hc_ref source utm_source utm_medium utm_campaign utm_term utm_content _rdr eav av comment_tracking ft lst".split()
TRACKING_PREFIXES = ["__cft__", "__tn__", "__so__", "acontext"]
# Address shapes that name a post, and the platform; a shape with a parameter is looked for in the query.
POST_SHAPES = [
    ("facebook", r"^https://[^/]+\.facebook\.com/groups/[^/]+/(?:posts|permalink)/(\d+)/"),
    ("facebook", r"^https://[^/]+\.facebook\.com/groups/[^/?]+/\?(?:.*&)?multi_permalinks=(\d+)"),
    ("facebook", r"^https://[^/]+\.facebook\.com/[^/?]+/(?:posts|videos|photos)/(?:[^/?]+/)?(\d+)/"),
    ("facebook", r"^https://[^/]+\.facebook\.com/(?:reel|watch/live|share/p)/(\d+)/"),
    ("facebook", r"^https://[^/]+\.facebook\.com/(?:permalink\.php|story\.php)/\?(?:.*&)?story_fbid=(\d+)"),
    ("facebook", r"^https://[^/]+\.facebook\.com/(?:photo\.php|photo)/\?(?:.*&)?fbid=(\d+)"),
    ("facebook", r"^https://[^/]+\.facebook\.com/watch/\?(?:.*&)?v=(\d+)"),
    ("tiktok", r"^https://[^/]+\.tiktok\.com/(?:@[^/]+/(?:video|photo)|v|embed(?:/v2)?)/(\d+)(?:\.html)?/"),
]


def page_address(url: Column) -> Column:
    """https, lower-case host without mobile prefixes, no fragment, no tracking parameters, sorted rest, one closing slash.

    Text that is no web address is trimmed and kept; null stays null.
    """
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1)), r"^(?:(?:m|web|mbasic|touch|business)\.|(?=(?:facebook|tiktok)\.com$))", "www.")
    path = F.regexp_replace(F.concat(F.regexp_extract(u, r"^https?://[^/?#]*([^?#]*)", 1), F.lit("/")), r"/+$", "/")
    path = F.regexp_replace(path, r"^/groups/(\d+)/(?:posts|permalink)/(\d+).*$", "/groups/$1/posts/$2/")
    pairs = F.filter(
        F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"),
        lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).isin(*TRACKING) & ~F.lower(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")"),
    )
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(u.rlike(r"^https?://[^/?#]+"), F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))).otherwise(u)


# Shapes of one post's address, and the one they are brought to; the query is sorted by then.
ONE_SHAPE = [
    (r"^(https://[^/]+)/groups/([^/]+)/(?:posts|permalink)/(\d+)/.*$", "$1/groups/$2/posts/$3/"),
    (r"^(https://[^/]+)/groups/([^/]+)/\?(?:.*&)?multi_permalinks=(\d+).*$", "$1/groups/$2/posts/$3/"),
    (r"^(https://[^/]+)/(?:permalink|story)\.php/\?(?:.*&)?id=(\d+)(?:&.*)?&story_fbid=(\w+).*$", "$1/permalink.php/?id=$2&story_fbid=$3"),
    (r"^(https://[^/]+)/photo(?:\.php)?/\?(?:.*&)?fbid=(\d+).*$", "$1/photo/?fbid=$2"),
    (r"^(https://[^/]+)/(?:watch/\?(?:.*&)?v=|watch/live/\?(?:.*&)?v=|[^/?]+/videos/(?:[^/?]+/)?)(\d+).*$", "$1/watch/?v=$2"),
    (r"^(https://[^/]+/[^/?]+/posts/[^?]+)\?.*$", "$1"),
    (r"^(https://[^/]+/share/[^?]+)\?.*$", "$1"),
    (r"^(https://[^/]+/@[^/]+/(?:video|photo)/\d+/).*$", "$1"),
    (r"^(https://(?:fb\.watch|v[mt]\.tiktok\.com)/[^?]+)\?.*$", "$1"),
]


def permalink(url: Column) -> Column:
    """The one address of a post that is written in several ways; other addresses as ``page_address`` has them."""
    out = page_address(url)
    for shape, to in ONE_SHAPE:
        out = F.regexp_replace(out, shape, to)
    return out


def targets_of(page: Column) -> Column:
    """All targets that may lead to a page: the page itself and what stands before each slash of its path."""
    parts = F.split(F.regexp_replace(page, "/+$", ""), "/")
    return F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def post_of(url: Column) -> Column:
    """``platform:post`` of an address that names a post, whatever its shape; null for others."""
    u = page_address(url)
    found = [(platform, F.regexp_extract(u, shape, 1)) for platform, shape in POST_SHAPES]
    return F.coalesce(*(F.when(post != "", F.concat(F.lit(f"{platform}:"), post)) for platform, post in found))


def sighting_context(page_url: Column, container: Column) -> Column:
    """``container:id``, else ``page:host/path`` without query, else ``page:unknown``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(page_url, r"^https?://([^/?#]+)", 1)), r"^(www|m|mbasic|web)\.", "")
    path = F.regexp_replace(F.regexp_extract(page_url, r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    page = F.when(host != "", F.concat(F.lit("page:"), host, F.when(path == "", F.lit("/")).otherwise(path)))
    return F.when(F.coalesce(container, F.lit("")) != "", F.concat(F.lit("container:"), container)).otherwise(F.coalesce(page, F.lit("page:unknown")))
