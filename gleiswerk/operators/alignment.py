"""Mixed days and templates: which rows of a day belong to one trip.

A day of a line may hold the rows of several trips. Rows meet the positions of
the line's templates by name; the assignment is mutual: each row takes its
nearest position (a template may pass a station twice), then each position its
nearest row. Along the template the rows of the longest non-decreasing times
stay, with those of unknown time. A day is replaced by what follows the
template that covers most of it, where the thresholds say that the day holds
more than one trip; else a day that goes back in time is cut to its longest
run that doesn't.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names of so many characters also match those that they begin, or that begin them, as second choice.
PREFIX = 4
#: How far a row of unknown time is from any position.
UNKNOWN = 1440
#: Departures that go back further are of another trip.
JUMP = 15


def longest_non_decreasing(values: list[int]) -> list[int]:
    """Indices of a longest non-decreasing subsequence: the one whose end, then each link before it, comes first."""
    tails: list[int] = []
    size: list[int] = []
    for v in values:
        k = bisect_right(tails, v)
        tails[k : k + 1] = [v]
        size.append(k + 1)
    if not size:
        return []
    out = [size.index(max(size))]
    while size[out[-1]] > 1:
        at = out[-1]
        out.append(next(j for j in range(at) if size[j] == size[at] - 1 and values[j] <= values[at]))
    return out[::-1]


def _chain(times: pd.Series) -> pd.Series:
    return times.map(lambda x: longest_non_decreasing(list(x)))


def assigned(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """(line, date, template, pos, ord, minute): for each position of a template the row that is nearest to it, of those for which it is the nearest position.

    ``rows`` has line, date, ord (its place in the day), station and minute (or
    null), ``templates`` line, k, stations and times. A row's names come before
    its times: an equal name is nearer than one that only begins alike. Rows of
    a day that have name and time alike are as near to each position, so the
    first stands for them all before any meets the templates.
    """
    places = templates.select("line", F.col("k").alias("template"), F.posexplode(F.arrays_zip(F.col("stations").alias("s"), F.col("times").alias("t"))).alias("pos", "c"))
    places = places.select("line", "template", "pos", F.col("c.s").alias("halt"), F.col("c.t").alias("time"), F.left("c.s", F.lit(2)).alias("start"))
    own = rows.groupBy("line", "date", "station", "minute").agg(F.min("ord").alias("ord")).withColumn("start", F.left("station", F.lit(2)))
    alike = (F.length("station") >= PREFIX) & (F.startswith("halt", "station") | F.startswith("station", "halt"))
    met = own.join(places, ["line", "start"]).withColumn("cost", F.when(F.col("station") == F.col("halt"), 0).when(alike, 1)).where("cost is not null")
    off = F.coalesce(F.abs(F.col("minute") - F.col("time")), F.lit(UNKNOWN))
    # a day's rows are together from here on: each step below groups within (line, date)
    met = met.withColumn("off", off).repartition("line", "date")
    nearest = met.groupBy("line", "date", "template", "ord", "minute").agg(F.min(F.struct("cost", "off", "pos")).alias("n"))
    return nearest.groupBy("line", "date", "template", F.col("n.pos").alias("pos")).agg(F.min(F.struct(F.col("n.off").alias("off"), F.col("ord"), F.col("minute"))).alias("b")).select("line", "date", "template", "pos", "b.ord", "b.minute")


def align(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """(line, date, template, pos, ord) of the rows that follow a template in time, and of those assigned without a time."""
    found = assigned(rows, templates)
    timed = F.filter("c", lambda x: x["minute"].isNotNull())
    days = found.groupBy("line", "date", "template").agg(F.array_sort(F.collect_list(F.struct("pos", "ord", "minute"))).alias("c"))
    days = days.select("line", "date", "template", timed.alias("timed"), F.filter("c", lambda x: x["minute"].isNull()).alias("untimed"))
    chain = days.withColumn("chain", F.pandas_udf(_chain, "array<int>")(F.transform("timed", lambda x: x["minute"])))
    kept = F.concat(F.transform("chain", lambda i: F.get("timed", i)), "untimed")
    return chain.select("line", "date", "template", F.explode(kept).alias("r")).select("line", "date", "template", "r.pos", "r.ord")


def _in_order() -> Window:
    return Window.partitionBy("line", "date").orderBy("ord")


def _goes_back(jump: int) -> Column:
    before = F.last("minute", True).over(_in_order().rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(before - F.col("minute") > jump, F.lit(False))


def marked(rows: DataFrame, jump: int = JUMP) -> DataFrame:
    """``rows`` with ``back``, whether a row goes back in time, and ``run``, how many up to it do. Who reads them several times writes them once."""
    if "run" in rows.columns:
        return rows
    return rows.withColumn("back", _goes_back(jump)).withColumn("run", F.sum(F.when(F.col("back"), 1).otherwise(0)).over(_in_order()))


def choose(rows: DataFrame, aligned: DataFrame, jump: int = JUMP) -> DataFrame:
    """(line, date, n, mixed, template, covered, action) for each day: ``template`` where the best template (or null) is taken, ``segment`` where a mixed day is cut, ``none``.

    Days of fewer than 6 rows stay. A mixed day takes its best template if that
    covers 4 rows and a fifth of the day; one in order, if 5 rows and less than
    70 % (a trip alone is covered nearly whole).
    """
    days = marked(rows, jump).groupBy("line", "date").agg(F.count("*").alias("n"), F.bool_or("back").alias("mixed"))
    cover = aligned.groupBy("line", "date", "template").agg(F.count("*").alias("covered"))
    best = cover.groupBy("line", "date").agg(F.min(F.struct((-F.col("covered")).alias("less"), "template")).alias("b")).select("line", "date", F.col("b.template").alias("template"), (-F.col("b.less")).alias("covered"))
    known = days.join(best, ["line", "date"], "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    enough = F.when(F.col("mixed"), (F.col("covered") >= 4) & (F.col("covered") >= 0.2 * F.col("n"))).otherwise((F.col("covered") >= 5) & (F.col("covered") < 0.7 * F.col("n")))
    action = F.when(F.col("n") < 6, "none").when(enough, "template").when(F.col("mixed"), "segment").otherwise("none")
    return known.select("line", "date", "n", "mixed", "template", "covered", action.alias("action"))


def normalised(rows: DataFrame, aligned: DataFrame, chosen: DataFrame, jump: int = JUMP) -> DataFrame:
    """(line, date, action, place, ord, station, delay): each day's rows after ``choose``, in order; a segment of fewer than 4 rows is not taken."""
    place = F.map_from_entries(F.collect_list(F.struct("ord", F.col("pos").cast("long"))))  # at most a row for each position of the template
    of_template = chosen.where("action = 'template'").join(aligned, ["line", "date", "template"]).groupBy("line", "date").agg(place.alias("places"))
    runs = marked(rows, jump)
    longest = runs.groupBy("line", "date", "run").agg(F.count("*").alias("size")).groupBy("line", "date").agg(F.min(F.struct((-F.col("size")).alias("less"), "run")).alias("b")).select("line", "date", "b.run", (-F.col("b.less")).alias("size"))
    decided = chosen.select("line", "date", "action").join(longest, ["line", "date"])
    decided = decided.withColumn("action", F.when((F.col("action") == "segment") & (F.col("size") < 4), "none").otherwise(F.col("action")))
    here = runs.withColumnRenamed("run", "own").join(decided.join(of_template, ["line", "date"], "left"), ["line", "date"]).withColumn("place", F.col("places")[F.col("ord")])
    stays = F.when(F.col("action") == "template", F.col("place").isNotNull()).when(F.col("action") == "segment", F.col("own") == F.col("run")).otherwise(True)
    return here.where(stays).select("line", "date", "action", F.when(F.col("action") == "template", F.col("place")).otherwise(F.col("ord")).alias("place"), "ord", "station", "delay")


def day_delays(rows: DataFrame) -> DataFrame:
    """(line, date, action, kept, end_delay, max_delay, max_station) of normalised days."""
    end = F.max_by("delay", F.when(F.col("delay").isNotNull(), F.col("place")))
    top = F.min(F.when(F.col("delay").isNotNull(), F.struct((-F.col("delay")).alias("less"), "place", "station")))
    return rows.groupBy("line", "date", "action").agg(F.count("*").alias("kept"), end.alias("end_delay"), top.alias("t")).select("line", "date", "action", "kept", "end_delay", (-F.col("t.less")).alias("max_delay"), F.col("t.station").alias("max_station"))
