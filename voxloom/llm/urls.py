"""URL filters by a temporal list join: entries become validity intervals, captures meet those active at fetch time.

A list entry (key, day, action) holds from its day, which may be a date, a timestamp or text of one, until the next entry of the same key.  Keys are a
host, one of its parent domains, or a host with any number of leading path segments.  Of the entries active at a capture's fetch time the most
specific decides: longer paths, then longer hosts.  Entries of one key and time are one, 'block' before 'allow'.

The as-of join is an equi-join on (key, month) over intervals cut at months, with the interval's range as the
remaining condition, so a key of many entries costs a capture only those of one month and each key matches at most once.
Captures are reduced to distinct (url, time) first; a hot url costs one row there.  Candidate keys are made only of as many host labels and path
segments as some key of the list has, so no capture asks for a bare top-level domain that no list names.  DataFrame functions only.

Null urls, urls without a host, and captures without a time match nothing: action null, blocked false.  Repeated captures
are rows of their own.  Entries without key, time or a known action are ignored.  Other columns of captures are kept, whatever
their names, but for action, matched_key and blocked, which are replaced; empty tables of either side are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+(/[^?#]*)"
FAR = "9999-12-31"
URL, TIME = "__filter_url", "__filter_time"  # names no other column has


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to): at most one entry of a key is valid at any time."""
    at = F.col("day").try_cast("timestamp_ntz")
    one = entries.where("key is not null and action in ('block', 'allow')").select(F.lower("key").alias("key"), at.alias("valid_from"), "action").where("valid_from is not null")
    one = one.groupBy("key", "valid_from").agg(F.max("action").alias("action"))
    # A key's group is its own history on the list.
    w = Window.partitionBy("key").orderBy("valid_from")
    return one.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(w), F.lit(FAR).cast("timestamp_ntz")))


def levels(entries: DataFrame) -> tuple[list[int], list[int]]:
    """How many host labels keys without a path have, and how many path segments the others: few numbers, whatever the list's size."""
    host, rest = F.split("key", "/", 2)[0], F.size(F.split("key", "/")) - 1
    kinds = entries.where("key is not null").select(F.when(rest == 0, F.size(F.split(host, r"[.]"))).alias("labels"), rest.alias("segments")).distinct()
    one = kinds.agg(F.collect_set("labels"), F.collect_set(F.when(F.col("segments") > 0, F.col("segments")))).first()
    return sorted(one[0]), sorted(one[1])


def candidate_keys(url, labels: list[int], segments: list[int]) -> F.Column:
    """Array of (key, rank) that may decide over a url, the more specific of higher rank, with as many labels and segments as given."""
    none = F.array().cast("array<struct<key:string,rank:int>>")
    host = F.lower(F.regexp_extract(url, HOST, 1))
    names, parts = F.split(host, r"[.]"), F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
    out = none
    if labels:
        some = F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.size(names))
        out = F.concat(out, F.transform(some, lambda n: F.struct(F.array_join(F.slice(names, F.size(names) - n + 1, n), ".").alias("key"), n.cast("int").alias("rank"))))
    if segments:
        some = F.filter(F.array(*map(F.lit, segments)), lambda n: n <= F.size(parts))
        out = F.concat(out, F.transform(some, lambda n: F.struct(F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(parts, 1, n), "/"))).alias("key"), (F.lit(1000) + n).cast("int").alias("rank"))))
    return F.when(host != "", out).otherwise(none)


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """Every capture with action, matched_key and blocked, by the entries active when it was fetched (column ``day``)."""
    captures = captures.drop("action", "matched_key", "blocked").withColumns({URL: F.col(url), TIME: F.col(day).try_cast("timestamp_ntz")})
    seen = captures.where(F.col(URL).isNotNull() & F.col(TIME).isNotNull()).select(URL, TIME).distinct()
    month = F.trunc(F.col(TIME).cast("date"), "month")
    keys = seen.select(URL, TIME, month.alias("month"), F.inline(candidate_keys(F.col(URL), *levels(entries))))
    # Only months that hold a capture matter, so intervals open at the end stop at the last of them.
    lo, hi = captures.where(F.col(URL).isNotNull()).agg(F.min(TIME), F.max(TIME)).first()
    active = intervals(entries).withColumns({"lo": F.lit(lo).cast("timestamp_ntz"), "hi": F.lit(hi).cast("timestamp_ntz")}).where("valid_from < valid_to and valid_from <= hi and valid_to > lo")
    first, last = F.greatest("valid_from", "lo"), F.least(F.expr("valid_to - interval 1 microsecond"), F.col("hi"))
    months = F.sequence(F.trunc(first.cast("date"), "month"), F.trunc(last.cast("date"), "month"), F.expr("interval 1 month"))
    active = active.select("key", "action", "valid_from", "valid_to", F.explode(months).alias("month"))
    hit = keys.join(active, ["key", "month"]).where((F.col("valid_from") <= F.col(TIME)) & (F.col(TIME) < F.col("valid_to")))
    best = hit.groupBy(URL, TIME).agg(F.max(F.struct("rank", "key", "action")).alias("b")).select(URL, TIME, F.col("b.action").alias("action"), F.col("b.key").alias("matched_key"))
    out = captures.join(best, [URL, TIME], "left").drop(URL, TIME)
    return out.withColumn("blocked", F.coalesce(F.col("action") == "block", F.lit(False)))


#: The timed list of the query: every host of pages is blocked from a day and an hour that its length gives and delisted 60 days later, every
#: domain of two labels is blocked from a noon on, and host/fr is allowed from day 30.
_LIST = """
with hosts as (select distinct lower(regexp_extract(url, '{host}', 1)) as host from pages where url is not null),
named as (select host, regexp_extract(host, '([^.]+[.][^.]+)$', 1) as domain from hosts where host <> '')
select host as key, {from_} as day, 'block' as action from named
union all select host, {to_}, 'allow' from named
union all select distinct domain, {noon}, 'block' from named where domain like '%.net'
union all select concat(host, '/fr'), {thirtieth}, 'allow' from named
"""
_FROM, _TO = "(length(host) * 37) % 300 * 24 + length(host) % 24", "((length(host) * 37) % 300 + 60) * 24 + length(host) % 24"


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    after = lambda hours: f"timestampadd(HOUR, cast({hours} as int), timestamp_ntz '2024-01-01 00:00:00')"
    text = _LIST.format(host=HOST.replace("\\", "\\\\"), from_=after(_FROM), to_=after(_TO), noon=after("200 * 24 + 12"), thirtieth=after("30 * 24"))
    entries = spark.sql(text.replace("from pages", "from {pages}"), pages=pages)
    captures = pages.withColumn("fetched", F.expr(after("pmod(page_id, 360) * 24 + pmod(page_id * 7, 24)")))
    out = evaluate(captures, entries)
    return out.select("page_id", "url", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "action", "matched_key", "blocked")


def _after(hours: str) -> str:
    return f"timestamp '2024-01-01 00:00:00' + to_hours(({hours})::bigint)"


OP8_SQL = (
    "with list as ("
    + _LIST.format(host=HOST, from_=_after(_FROM), to_=_after(_TO), noon=_after("200 * 24 + 12"), thirtieth=_after("30 * 24"))
    + f"""),
one as (select key, day, max(action) as action from list group by key, day),
spans as (select key, action, day as valid_from, coalesce(lead(day) over (partition by key order by day), timestamp '{FAR}') as valid_to from one),
captures as (select page_id, url, timestamp '2024-01-01 00:00:00' + to_hours((page_id % 360 * 24 + (page_id * 7) % 24)::bigint) as fetched, lower(regexp_extract(url, '{HOST}', 1)) as host,
  list_filter(string_split(regexp_extract(url, '{PATH}', 1), '/'), lambda x: x <> '') as parts, row_number() over () as r from pages),
keys as (
  select r, fetched, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as key, len(string_split(host, '.')) - i + 1 as rank
  from (select r, fetched, host, unnest(range(1, len(string_split(host, '.')) + 1)) as i from captures where host <> '')
  union all
  select r, fetched, host || '/' || lower(array_to_string(list_slice(parts, 1, i), '/')), 1000 + i from (select r, fetched, host, parts, unnest(range(1, len(parts) + 1)) as i from captures where host <> '')),
hits as (select r, s.action, k.key, row_number() over (partition by r order by k.rank desc, k.key desc) as n
  from keys k join spans s on s.key = k.key and s.valid_from <= k.fetched and k.fetched < s.valid_to)
select c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d %H:%M:%S') as fetched, h.action, h.key as matched_key, coalesce(h.action = 'block', false) as blocked
from captures c left join hits h on h.r = c.r and h.n = 1
"""
)
