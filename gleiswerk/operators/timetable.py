"""Timetable services: connections, lines, stations, and numbers for services that have none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calls(services: DataFrame) -> DataFrame:
    """A row for each call of a service: its place in the order, station and planned minute."""
    return services.select("service", "line", "train_type", F.posexplode(F.arrays_zip("stations", "times")).alias("pos", "c")).select("service", "line", "train_type", "pos", F.col("c.stations").alias("station"), F.col("c.times").alias("minute"))


def connections(services: DataFrame, origin: str, destination: str) -> DataFrame:
    """Services that call at the origin and later at the destination: departure, arrival, duration (null unless positive).

    Only the calls at these two stations are kept before they meet, by service.
    """
    rows = calls(services)
    a = rows.where(F.col("station") == origin).groupBy("service", "line", "train_type").agg(F.min("pos").alias("p1"), F.min_by("minute", "pos").alias("dep"))
    b = rows.where(F.col("station") == destination).select("service", F.col("pos").alias("p2"), F.col("minute").alias("m2"))
    later = a.join(b, "service").where("p2 > p1").groupBy("service", "line", "train_type", "dep").agg(F.min_by("m2", "p2").alias("arr"))
    return later.withColumn("duration", F.when(F.col("arr") > F.col("dep"), F.col("arr") - F.col("dep")))


def first_departures(found: DataFrame, k: int) -> DataFrame:
    """Sorted first, then limited."""
    return found.orderBy("dep", "service").limit(k)


def around(found: DataFrame, minute: int, before: int = 30, after: int = 120) -> DataFrame:
    """Departures in the window, each with the nearest earlier and later departure of all."""
    d = F.col("dep")
    hint = found.agg(F.max(F.when(d <= minute, d)).alias("earlier"), F.min(F.when(d > minute, d)).alias("later"))
    return found.where(d.between(minute - before, minute + after)).join(F.broadcast(hint))


def numbers_by_similarity(unnumbered: DataFrame, numbered: DataFrame, least: float = 0.5, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """The best candidate of each service without a number, among those of its type that share an end.

    Score: 0.45 times the bonus of the ends (both 1, first .55, last .25) and
    0.55 times the Jaccard similarity of the states passed. Services of one way
    (type, ends and states) score alike, so ways meet, not services: those of an
    equal end that also share a state among the first few of both, in an order
    common to all. Of n states so many may be missing elsewhere that the rest is
    too little for the score, so a candidate has one of the first that remain.
    A way is known by the first of its services where its states aren't needed,
    and pairs are scored where they meet: few are shuffled again. ``keep`` may
    write the ways, which are read several times.
    """
    way = ("train_type", "first", "last", "states")
    asked = unnumbered.groupBy(*way).agg(F.collect_list("service").alias("services"), F.min("service").alias("way"))
    asked = keep(asked, "asked")
    known = keep(numbered.groupBy(*way).agg(F.min("service").alias("num"), F.count("*").alias("n")), "known")
    jaccard = F.size(F.array_intersect("u_states", "c_states")) / F.size(F.array_union("u_states", "c_states"))

    def scored(pairs: DataFrame, bonus: float) -> DataFrame:
        return pairs.select("train_type", "way", "num", "n", F.round(0.45 * bonus + 0.55 * jaccard, 4).alias("score")).where(F.col("score") >= least)

    u_states, c_states = F.col("states").alias("u_states"), F.col("states").alias("c_states")
    parts = []
    for end, other, bonus in (("first", "last", 0.55), ("last", "first", 0.25)):
        # ways of both ends alike score more, and need not be similar; they meet by their ends alone, below
        needed = max(0.0, (least - 0.5e-4 - 0.45 * bonus) / 0.55)
        size = F.size("states")
        start = F.slice("states", F.lit(1), F.greatest(size - F.ceil(size * needed).cast("int") + 1, F.lit(1)))
        u = asked.select("train_type", F.col(end).alias("end"), F.explode(start).alias("state"), F.col(other).alias("u_other"), u_states, "way")
        c = known.select("train_type", F.col(end).alias("end"), F.explode(start).alias("state"), F.col(other).alias("c_other"), c_states, "num", "n")
        parts.append(scored(u.join(c, ["train_type", "end", "state"]).where("u_other <> c_other"), bonus).distinct())
    ends = ["train_type", "first", "last"]
    parts.append(scored(asked.select(*ends, u_states, "way").join(known.select(*ends, c_states, "num", "n"), ends), 1.0))
    met = parts[0].unionByName(parts[1]).unionByName(parts[2])
    best = met.groupBy("train_type", "way").agg(F.min(F.struct((-F.col("score")).alias("less"), "num")).alias("b"), (F.sum("n") > 1).alias("several"))
    best = best.select("train_type", "way", F.col("b.num").alias("num"), (-F.col("b.less")).alias("score"), "several")
    return asked.select("train_type", "way", "services").join(best, ["train_type", "way"]).select(F.explode("services").alias("service"), "num", "score", "several")


def regions_by_vote(services: DataFrame) -> DataFrame:
    """Each end station's region, by the votes of the services that begin or end there."""
    ends = services.select("region", F.explode(F.array_distinct(F.array(F.element_at("stations", 1), F.element_at("stations", -1)))).alias("station"))
    votes = ends.groupBy("station", "region").agg(F.count("*").alias("n"))
    return votes.groupBy("station").agg(F.min_by("region", F.struct(-F.col("n"), F.col("region"))).alias("region"), F.sum("n").alias("votes"))


def regions_passed(services: DataFrame, of_station: DataFrame) -> DataFrame:
    """The regions that a service passes."""
    rows = services.select("service", F.explode("stations").alias("station")).join(of_station.select("station", "region"), "station")
    return rows.groupBy("service").agg(F.array_join(F.array_sort(F.collect_set("region")), ",").alias("regions"))


def lines_of_type(services: DataFrame, kind: str) -> DataFrame:
    """The lines of a type; a line's name must begin with it and go on with a digit."""
    return services.where((F.col("train_type") == kind) & F.col("line").rlike(f"^{kind}[0-9]")).select("line").distinct()


def services_of_lines(services: DataFrame) -> DataFrame:
    """A row for each line, ends and departure: the service of the most days."""
    rows = services.select("line", "service", "n_days", F.element_at("stations", 1).alias("first"), F.element_at("stations", -1).alias("last"), F.col("times")[0].alias("dep"))
    w = Window.partitionBy("line", "first", "last", "dep").orderBy(F.desc("n_days"), "service")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def station_index(services: DataFrame) -> DataFrame:
    """Stations by the first letter of their names."""
    names = services.select(F.explode("stations").alias("station")).distinct()
    return names.groupBy(F.upper(F.substring("station", 1, 1)).alias("letter")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("station")), "|").alias("stations"))
