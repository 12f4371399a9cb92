"""Rule tables: delay codes, keywords of remarks, suffixes of station names.

Fixed values: results depend on them as they stand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of delay codes (first, last, category); what is in none is 'sonstiges'.
CODE_RANGES = (
    (1, 4, "kaskade"), (5, 6, "einsatz"), (7, 7, "wetter"), (8, 9, "sonstiges"), (10, 11, "passagier"), (12, 12, "bereitstellung"),
    (13, 16, "passagier"), (17, 19, "einsatz"), (20, 27, "fahrzeug"), (28, 29, "wagen"), (30, 39, "bau"), (40, 46, "infrastruktur"),
    (47, 59, "strecke"), (60, 69, "bereitstellung"), (70, 79, "wetter"), (80, 98, "sonstiges"), (99, 99, "keine"),
)

#: Kinds of construction by code; others are 'bauarbeiten'.
CONSTRUCTION = {33: "strecke_rep", 34: "strecke_rep", 35: "strecke_rep", 37: "langsamfahrt", 38: "langsamfahrt", 39: "sperrung", 40: "oberleitung_rep", 43: "weiche_rep", 44: "sperrung"}

#: Keywords of archived remarks; the first category with one decides.
REMARK_RULES = (
    ("kaskade", ("vorausfahrenden zuges", "vorheriger fahrt", "vorfahrt eines anderen", "entgegenkommenden zug", "warten auf anschluss", "verspätung im ausland", "vorausfahrende")),
    ("bereitstellung", ("bereitstellung", "personal aus vorheriger", "personalausfall", "kurzfristiger personal", "verfügbarkeit der gleise", "warten auf personal")),
    ("fahrzeug", ("technische störung am zug", "technischer defekt", "defekt an einem anderen zug", "störung am fahrzeug", "türstörung", "lokschaden", "wagenschaden")),
    ("infrastruktur", ("reparatur an einem signal", "signal", "reparatur an einer weiche", "weiche", "oberleitung", "stellwerk", "bahnübergang", "reparatur an der strecke", "geschwindigkeit auf der strecke")),
    ("bau", ("bauarbeiten", "baustelle", "revision", "instandhaltung")),
    ("strecke", ("streckensperrung", "sperrung", "unbefugte personen", "personen auf der strecke", "notarzteinsatz auf der strecke", "feuerwehreinsatz auf der strecke", "beschädigung einer brücke", "umleitung", "hindernis", "tier")),
    ("wetter", ("wetter", "sturm", "unwetter", "schnee", "eis", "glätte", "hochwasser", "hitze", "orkan", "regen")),
    ("einsatz", ("polizeieinsatz", "feuerwehreinsatz", "notarzteinsatz", "rettung", "notarzt", "polizei", "einsatz")),
    ("passagier", ("fahrgast", "passagier", "haltezeit am bahnhof", "reisende", "warten auf anschlussreisende")),
)

#: Keywords of incident messages, in another order and with other words.
INCIDENT_RULES = (
    ("bereitstellung", ("bereitstellung", "vorheriger fahrt", "vorausfahrenden zuges", "vorausfahrenden zug", "wartung des zuges", "fahrzeugbereitstellung")),
    ("fahrzeug", ("technische störung am zug", "störung am fahrzeug", "defekt am zug", "fahrzeugstörung", "türstörung", "tür", "lokschaden", "schaden am fahrzeug", "wagenschaden", "technischer defekt")),
    ("infrastruktur", ("signalstörung", "reparatur an einem signal", "signal", "weichenstörung", "weiche", "oberleitung", "stromabnehmer", "leitungsstörung", "stellwerk", "störung im betriebsablauf", "infrastruktur", "bahnübergang")),
    ("bau", ("bauarbeiten", "baustelle", "bauwerk", "gleisbau", "revision", "instandhaltung", "brückenarbeiten", "bau")),
    ("strecke", ("streckensperrung", "streckenunterbrechung", "gleissperrung", "gleisbelegung", "strecke gesperrt", "gesperrt", "behinderung auf der strecke", "strecke")),
    ("wetter", ("wetter", "sturm", "unwetter", "schnee", "eisglätte", "glätte", "hochwasser", "hitze", "orkan", "regen")),
    ("einsatz", ("polizeieinsatz", "feuerwehr", "rettungseinsatz", "notarzteinsatz", "notarzt", "rettung", "polizei", "einsatz", "gefahrgut")),
    ("passagier", ("personen im gleis", "personenschaden", "reiseverzicht", "passagier", "fahrgast", "tier im gleis", "notfall")),
)

#: Severity of a category, 1 to 3.
SEVERITY = {"strecke": 3, "einsatz": 2, "infrastruktur": 2, "fahrzeug": 2, "bau": 2, "sonstiges": 2, "bereitstellung": 1, "passagier": 1, "kaskade": 1, "wetter": 2}

#: States by a suffix of the station's name.
SUFFIX_STATES = (
    ("(westf)", "NRW"), ("(ruhr)", "NRW"), ("(rhld)", "NRW"), ("(berg)", "NRW"), ("(niederrhein)", "NRW"), ("(sachs)", "SN"), ("(oberlausitz)", "SN"),
    ("(bay)", "BY"), ("(allgäu)", "BY"), ("(oberbay)", "BY"), ("(niederbay)", "BY"), ("(thür)", "TH"), ("(thuer)", "TH"), ("(oldb)", "NI"), ("(nieders)", "NI"),
    ("(holst)", "SH"), ("(meckl)", "MV"), ("(mark)", "BB"), ("(niederlausitz)", "BB"), ("(saale)", "ST"), ("(anhalt)", "ST"), ("(harz)", "ST"), ("(lahn)", "HE"),
    ("(hess)", "HE"), ("(odenw)", "HE"), ("(breisgau)", "BW"), ("(württ)", "BW"), ("(baden)", "BW"), ("(pfalz)", "RP"), ("(saar)", "SL"),
)


def first_match(pairs: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    return reduce(lambda rest, p: F.when(p[0], p[1]).otherwise(rest), reversed(pairs), otherwise)


def code_category(code: Column) -> Column:
    """Delay code -> category of causes."""
    return first_match([(code.between(a, b), c) for a, b, c in CODE_RANGES], F.lit("sonstiges"))


def construction_kind(code: Column) -> Column:
    """Delay code of a construction -> its kind."""
    return first_match([(code == a, b) for a, b in CONSTRUCTION.items()], F.lit("bauarbeiten"))


def text_category(text: Column, rules: tuple = REMARK_RULES) -> Column:
    """Free text -> category by the first rule with a keyword in it."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return first_match([(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), c) for c, words in rules], F.lit("sonstiges"))


def severity(category: Column) -> Column:
    return first_match([(category == c, F.lit(n)) for c, n in SEVERITY.items()], F.lit(2))


def suffix_state(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return first_match([(low.contains(s), v) for s, v in SUFFIX_STATES], F.lit(None).cast("string"))


# -- the same as SQL ------------------------------------------------------------------


def sql_code_category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in CODE_RANGES) + " ELSE 'sonstiges' END"


def sql_construction(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {a} THEN '{b}'" for a, b in CONSTRUCTION.items()) + " ELSE 'bauarbeiten' END"


def sql_text_category(x: str, rules: tuple = REMARK_RULES) -> str:
    low = f"lower(trim(coalesce({x}, '')))"
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({low}, '{w}')" for w in words) + f" THEN '{c}'" for c, words in rules) + " ELSE 'sonstiges' END"


def sql_severity(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{c}' THEN {n}" for c, n in SEVERITY.items()) + " ELSE 2 END"


def sql_suffix_state(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower(trim({x})), '{s}') THEN '{v}'" for s, v in SUFFIX_STATES) + " END"
