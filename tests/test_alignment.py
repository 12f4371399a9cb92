"""Mixed days against a plain version, row by row."""

import random

import pytest

from gleiswerk.operators import alignment, rides
from gleiswerk.plans.testmodel import Model

ROWS = "line string, date string, ord long, station string, minute long, delay double"


def follow(rows, stations, times):
    """(pos, ord) of a day's rows on one template: mutual nearest, then every subsequence of times."""
    own = {}
    for r in rows:
        best = None
        for pos, (halt, time) in enumerate(zip(stations, times, strict=True)):
            alike = len(r["station"]) >= 4 and (halt.startswith(r["station"]) or r["station"].startswith(halt))
            if r["station"] == halt or alike:
                key = (r["station"] != halt, 1440 if r["minute"] is None else abs(r["minute"] - time), pos)
                best = min(best, key) if best else key
        if best:
            own.setdefault(best[2], []).append((best[1], r["ord"], r["minute"]))
    items = [(pos, *min(own[pos], key=lambda x: x[:2])[1:]) for pos in sorted(own)]
    timed = [x for x in items if x[2] is not None]
    size = []
    for k, x in enumerate(timed):
        size.append(1 + max((size[j] for j in range(k) if timed[j][2] <= x[2]), default=0))
    chain, at = set(), size.index(max(size)) if size else None
    while at is not None:
        chain.add(timed[at])
        at = next((j for j in range(at) if size[j] == size[at] - 1 and timed[j][2] <= timed[at][2]), None) if size[at] > 1 else None
    return [(pos, ord_) for pos, ord_, minute in items if minute is None or (pos, ord_, minute) in chain]


def decide(rows, found):
    n, before, mixed = len(rows), None, False
    for r in rows:
        if r["minute"] is not None:
            mixed = mixed or before is not None and r["minute"] < before - 15
            before = r["minute"]
    template = min(found, key=lambda k: (-len(found[k]), k)) if found else None
    covered = len(found[template]) if found else 0
    if n < 6:
        action = "none"
    elif covered >= 4 and covered >= 0.2 * n if mixed else covered >= 5 and covered < 0.7 * n:
        action = "template"
    else:
        action = "segment" if mixed else "none"
    return n, mixed, template, covered, action


def compare(rows, templates):
    by_day, by_line = {}, {}
    for r in rows.collect():
        by_day.setdefault((r.line, r.date), []).append(r.asDict())
    for t in templates.collect():
        by_line.setdefault(t.line, []).append(t)
    want, chosen = set(), set()
    for (line, date), own in by_day.items():
        own.sort(key=lambda r: r["ord"])
        found = {t.k: follow(own, t.stations, t.times) for t in by_line.get(line, [])}
        found = {k: x for k, x in found.items() if x}
        want |= {(line, date, k, pos, o) for k, x in found.items() for pos, o in x}
        chosen.add((line, date, *decide(own, found)))
    aligned = alignment.align(rows, templates)
    assert {tuple(r) for r in aligned.select("line", "date", "template", "pos", "ord").collect()} == want
    got = alignment.choose(rows, aligned).select("line", "date", "n", "mixed", "template", "covered", "action").collect()
    assert {tuple(r) for r in got} == chosen and len(got) == len(by_day)
    return {c[-1] for c in chosen}


def test_days_of_the_given_tables(spark):
    m = Model(spark, "/root/testdata/sf0.01")
    assert compare(m.patterned, rides.templates(m.patterned, station="station", minute="minute")) == {"template", "segment", "none"}


def test_random_days_on_templates_that_pass_a_station_twice(spark):
    rng = random.Random(7)
    names = ["Alt", "Altdorf", "Altdorf West", "Berg", "Bergen", "C", "Ulm", "Ulm Ost"]
    templates = [("L", k, [rng.choice(names) for _ in range(n)], [rng.randrange(0, 90) for _ in range(n)]) for k, n in ((1, 7), (2, 5), (3, 9))]
    rows = [("L", f"d{d}", o, rng.choice(names), rng.choice([None, *range(0, 90, 5)]), 1.0) for d in range(40) for o in range(rng.randrange(1, 16))]
    compare(spark.createDataFrame(rows, ROWS), spark.createDataFrame(templates, "line string, k int, stations array<string>, times array<long>"))


def test_a_mixed_day_takes_its_template_or_its_longest_run(spark):
    stations = ["Aaa", "Bbb", "Ccc", "Ddd", "Eee"]
    day = [(s, 100 + 10 * k, float(k)) for k, s in enumerate(stations)]
    other = [("Xxx", 50, 30.0), ("Yyy", 60, 31.0), ("Zzz", 20, 32.0), ("Zzz", 21, None)]
    rows = [("L", "one", o, *r) for o, r in enumerate(day + other, 1)] + [("M", "two", o, *r) for o, r in enumerate(day + other, 1)]
    rows = spark.createDataFrame(rows, ROWS)
    templates = spark.createDataFrame([("L", 1, stations, [100, 110, 120, 130, 140])], "line string, k int, stations array<string>, times array<long>")
    aligned = alignment.align(rows, templates)
    got = {r.line: r for r in alignment.day_delays(alignment.normalised(rows, aligned, alignment.choose(rows, aligned))).collect()}
    assert [(got[x].action, got[x].kept, got[x].end_delay, got[x].max_delay, got[x].max_station) for x in "LM"] == [("template", 5, 4.0, 4.0, "Eee"), ("segment", 5, 4.0, 4.0, "Eee")]


def test_no_rows_and_no_templates(spark):
    rows, templates = spark.createDataFrame([], ROWS), spark.createDataFrame([], "line string, k int, stations array<string>, times array<long>")
    aligned = alignment.align(rows, templates)
    assert aligned.count() == 0 and alignment.choose(rows, aligned).count() == 0 and alignment.normalised(rows, aligned, alignment.choose(rows, aligned)).count() == 0


@pytest.mark.parametrize("name", ["w07_aligned_rows", "w08_normalised_days"])
def test_query_has_rows(spark, name):
    from gleiswerk import plans

    assert plans.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 1000
