"""Enrichment tables: indicators, countries, places, videos."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chartlake.sources.staging import staged

EARTH_M = 6_371_000.0
PLACE = "results array<struct<name:string,formatted_address:string,rating:double,user_ratings_total:int,opening_hours:struct<open_now:boolean>,place_id:string>>"
GEOCODE = "status string, results array<struct<geometry:struct<location:struct<lat:double,lng:double>>,formatted_address:string>>"


def latest_indicator(points: DataFrame) -> DataFrame:
    """Value of the greatest year per indicator and country; a missing year is 0, ties go to the least id."""
    return points.groupBy("indicator", "country").agg(F.max_by("value", F.struct(F.coalesce("year", F.lit(0)), -F.col("id"))).alias("value"))


def indicator_grid(countries: DataFrame, indicators: DataFrame, latest: DataFrame) -> DataFrame:
    """Every country and indicator, 'no data' where nothing is known, and how many the country reports. The indicators are few, broadcast."""
    full = countries.crossJoin(F.broadcast(indicators)).join(latest, ["country", "indicator"], "left")
    return full.select("country", "indicator", F.when(F.col("value").isNotNull(), F.format_string("%.2f", "value")).otherwise("no data").alias("shown"), F.count("value").over(Window.partitionBy("country")).alias("reported"))


def folded(name: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(name), *_accents())


def _accents() -> tuple[str, str]:
    """Accented lower-case letters of the Latin blocks and the letters they are composed of."""
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250))}
    pairs = [(c, p) for c, p in plain.items() if p != c and p.isascii() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


#: Names of up to this length are found by their deletions, of which they have half its square; names that may meet longer ones, by thirds.
SHORT = 34


def _deletions(s: Column, most: int) -> Column:
    """s and what is left of it after deleting up to ``most`` characters."""
    found = F.array(s)
    for _ in range(most):
        cut = F.flatten(F.transform(found, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))))
        found = F.array_distinct(F.concat(found, cut))
    return found


def _third(s: Column, i: int) -> tuple[Column, Column]:
    """Start and length of the i-th third of s."""
    n = F.char_length(s)
    start = F.floor(n * i / 3).cast("int")
    return start + 1, F.floor(n * (i + 1) / 3).cast("int") - start


def _as_long(df: DataFrame, col: str, other: DataFrame, other_col: str, most: int) -> DataFrame:
    """The rows of df that have a name of the other table within ``most`` letters of their length; the lengths are few, broadcast."""
    size = F.char_length(other_col)
    sizes = other.select(F.explode(F.sequence(size - most, size + most)).alias("size")).distinct()
    return df.join(F.broadcast(sizes), F.char_length(col) == F.col("size"), "left_semi")


def _close(names: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """(n, code): folded names and the codes of known ones within the distance, found by a key which every such pair shares.

    A pair that shares several keys comes several times: pairs are measured as they meet, none is kept or sorted.

    Equal deletions, by their hash, or, of long ones, a third of the known name that two edits leave alone, found at most two places
    away. A name has hundreds of keys, which the size of the table it is read from does not tell: merge joins, never a broadcast.
    """
    names, known = _as_long(names, "n", known, "k", most), _as_long(known, "k", names, "n", most)
    keys = lambda c: F.explode(F.transform(_deletions(F.col(c), most), lambda d: F.xxhash64(d))).alias("key")
    short = names.where(F.char_length("n") <= SHORT).select("n", keys("n"))
    near = short.join(known.where(F.char_length("k") <= SHORT).select("k", "code", keys("k")).hint("merge"), "key").select("n", "k", "code")
    parts = [(i, *_third(F.col("k"), i)) for i in range(3)]
    index = known.where(F.char_length("k") >= SHORT - most).select("k", "code", F.char_length("k").alias("size"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.substring("k", at, n).alias("key")) for i, at, n in parts])).alias("p")).select("k", "code", "size", "p.*")
    sizes = F.explode(F.sequence(F.char_length("n") - most, F.char_length("n") + most))
    probes = names.where(F.char_length("n") >= SHORT - most).select("n", sizes.alias("size"))
    start = lambda i: F.floor(F.col("size") * i / 3).cast("int")
    probes = probes.select("n", "size", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (start(i) + 1 + d).alias("at"), (start(i + 1) - start(i)).alias("len")) for i in range(3) for d in range(-most, most + 1)])).alias("p")).where("p.at >= 1").select("n", "size", "p.i", F.substring("n", F.col("p.at"), F.col("p.len")).alias("key"))
    pairs = near.union(probes.distinct().join(index.hint("merge"), ["size", "i", "key"]).select("n", "k", "code"))
    return pairs.where(F.levenshtein("n", "k", most) >= 0).select("n", "code")


def resolve_country(names: DataFrame, countries: DataFrame, most: int = 2) -> DataFrame:
    """(name, code): the nearest country by edit distance within ``most`` (2 at most), ties by the least code; null else.

    Case and accents don't count. A name that equals a country is resolved at once; only the distinct others look further, first for
    countries one edit away, then two. Both tables may grow: pairs meet on keys, no name meets every country. A null name stays null.
    """
    known = staged(countries.select(folded(F.col("country")).alias("k"), "code").where("k is not null").groupBy("k").agg(F.min("code").alias("code")), "countries")
    asked = staged(names.select("name", folded(F.col("name")).alias("n")).distinct(), "names")
    open_names = asked.select("n").where("n is not null").distinct()
    exact = open_names.join(known.hint("merge"), F.col("n") == F.col("k"))
    found = staged(exact.select("n", "code"), "resolved")
    for distance in range(1, most + 1):
        rest = staged(open_names.join(found.hint("merge"), "n", "left_anti"), "unresolved")
        close = _close(rest, known, distance)
        found = found.union(staged(close.groupBy("n").agg(F.min("code").alias("code")), "resolved"))
    return asked.join(found.hint("merge"), "n", "left").select("name", "code")


def parse_places(df: DataFrame, col: str = "payload") -> DataFrame:
    """One row per place of an answer; open_now stays null where it is not told."""
    p = df.select("*", F.explode(F.from_json(col, PLACE)["results"]).alias("p"))
    url = F.concat(F.lit("https://www.google.com/maps/place/?q=place_id:"), F.col("p.place_id"))
    return p.select(*[c for c in df.columns if c != col], F.coalesce("p.name", F.lit("Unknown")).alias("name"), F.coalesce("p.formatted_address", F.lit("")).alias("address"), F.col("p.rating").alias("rating"), F.col("p.user_ratings_total").alias("reviews"), F.col("p.opening_hours.open_now").alias("open_now"), url.alias("maps_url"))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _on_sphere(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere: no date line, no poles."""
    lat, lon = F.radians(lat), F.radians(lon)
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def nearby(cities: DataFrame, places: DataFrame, radius_m: float = 10_000, limit: int = 5) -> DataFrame:
    """Places within the radius of each city, the nearest first: an equi-join on cells of a grid around the sphere.

    Points are cells of (x, y, z) with sides of two chords of the radius; a city asks the cells within a chord of it, one or two an
    axis. So the result is whole everywhere. Rows without coordinates are near nothing. Positions meet once, however many rows share
    them: of the places at one position only the first ``limit`` can be listed, and of the positions around a city only the first
    ``limit`` by distance and least place.
    """
    chord = max(2 * math.sin(min(radius_m / (2 * EARTH_M), math.pi / 2)), 1e-7) * (1 + 1e-9)
    cell = lambda c: F.floor(c / (2 * chord))
    axes, city, spot = ("_x", "_y", "_z"), ["clat", "clon"], ["lat", "lon"]
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # + 0.0 makes one zero of the two
    at = lambda df, key, lat, lon: df.where(known).select(key, (F.col("lat").cast("double") + 0.0).alias(lat), (F.col("lon").cast("double") + 0.0).alias(lon))
    named = at(cities, "city_id", *city)
    c = named.select(*city).distinct().select(*city, *[p.alias(f"p{a}") for a, p in zip(axes, _on_sphere(F.col("clat"), F.col("clon")), strict=True)])
    for a in axes:
        c = c.withColumn(a, F.explode(F.sequence(cell(F.col(f"p{a}") - chord), cell(F.col(f"p{a}") + chord))))
    first = lambda rows, by, *order: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= limit)
    p = first(at(places, "place_id", *spot), spot, "place_id").groupBy(*spot).agg(F.sort_array(F.collect_list("place_id")).alias("ids"))
    p = p.select("*", *[cell(x).alias(a) for a, x in zip(axes, _on_sphere(F.col("lat"), F.col("lon")), strict=True)])
    j = c.join(p, list(axes)).withColumn("distance", F.round(haversine_m(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon")), 3)).where(F.col("distance") <= radius_m)
    near = first(j.select(*city, "distance", "ids"), city, "distance", F.get("ids", F.lit(0))).select(*city, "distance", F.explode("ids").alias("place_id"))
    own = named.join(first(near, city, "distance", "place_id").drop("rank"), city)
    return first(own, ["city_id"], "distance", "place_id").select("city_id", "rank", "place_id", "distance")


def parse_geocode(df: DataFrame, col: str = "payload") -> DataFrame:
    """outcome (ok, not_found, error) with position and address of the first result."""
    j = df.withColumn("_j", F.from_json(col, GEOCODE))
    first = F.get(F.col("_j.results"), F.lit(0))
    ok = (F.col("_j.status") == "OK") & first.isNotNull()
    outcome = F.when(ok, "ok").when(F.col("_j.status") == "ZERO_RESULTS", "not_found").otherwise("error")
    return j.select(*[c for c in df.columns if c != col], outcome.alias("outcome"), F.when(ok, first["geometry"]["location"]["lat"]).alias("lat"), F.when(ok, first["geometry"]["location"]["lng"]).alias("lon"), F.when(ok, first["formatted_address"]).alias("address"))


def trusted_filter(videos: DataFrame, allow: DataFrame, limit: int = 3, fallback: str = "en") -> DataFrame:
    """The first `limit` videos of each query whose channel starts with a name of its language's list; other languages use the fallback's.

    videos: query_id, position, lang, channel, video_id. The allow-list (lang, prefix) is short, broadcast.
    """
    known = F.broadcast(allow.select(F.col("lang").alias("known")).distinct())
    v = videos.where("video_id is not null").join(known, F.col("lang") == F.col("known"), "left").withColumn("use", F.coalesce("known", F.lit(fallback)))
    a = F.broadcast(allow.select(F.col("lang").alias("use"), "prefix"))
    ok = v.join(a, (v["use"] == a["use"]) & F.startswith(F.lower(F.trim(v["channel"])), F.lower(F.trim(a["prefix"]))), "left_semi")
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("rank") <= limit).drop("known", "use")


def clip_description(text: Column, most: int = 120) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
