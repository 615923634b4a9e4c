"""Names with alliance tags: clean-up, detection of tracked alliances, header and subtitle classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The default catalog as (tag, name, further spellings); pass another one to track others.
CATALOG = [
    ("GODt", "GOD of Thunder", ["GODT", "GOD OF THUNDER", "GOD OFTHUNDER", "GODTHUNDER"]),
    ("V57", "Legacy of Velmora", ["V57", "LEGACY OF VELMORA", "LEGACY VELMORA", "VELMORA"]),
    ("P57R", "PHOENIX RISING 4057", ["P57R", "PHOENIX RISING", "PHOENIX RISING 4057"]),
]
TITLES = ["leader", "warlord", "envoy", "officer", "council", "r4", "r5", "king", "queen"]
BOARD_HEADERS = {"individual power": "individual_power", "individualpower": "individual_power", "mad scientist": "mad_scientist", "madscientist": "mad_scientist", "fort destroyer": "fort_destroyer", "fortdestroyer": "fort_destroyer", "fort destroy": "fort_destroyer", "governor profile": "governor_profile_power", "kill point": "kill_point", "killpoint": "kill_point"}
METRIC_HEADERS = {"power": "power", "contribution": "contribution_points", "fort": "fort_destroying", "destroy": "fort_destroying", "kill points": "kill_points", "kill point": "kill_points"}
BOARD_TOKENS = ["INDIVIDUAL POWER", "MAD SCIENTIST", "FORT DESTROYER", "KILL POINT"]

Catalog = list[tuple[str, str, list[str]]]


def token(text: str | Column) -> str | Column:
    if isinstance(text, str):
        return "".join(c for c in text.upper() if c.isascii() and c.isalnum())
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def label(entry: tuple[str, str, list[str]]) -> str:
    return f"[{entry[0]}] {entry[1]}"


def _by_bracket(raw: Column, catalog: Catalog) -> Column:
    t = token(F.regexp_extract(raw, r"[\[(]([^\])]{2,12})[\])]?", 1))
    out = F.lit(None).cast("string")
    for e in catalog:
        out = F.when(t == token(e[0]), label(e)).otherwise(out)
    return out


def _by_alias(raw: Column, catalog: Catalog) -> Column:
    t = token(raw)
    names = [(token(a), label(e)) for e in catalog for a in e[2]]
    near = F.lit(None).cast("string")
    for a, name in reversed([x for x in names if len(x[0]) >= 3]):
        near = F.when(t.contains(a) | F.lit(a).contains(t), name).otherwise(near)
    out = near
    for a, name in reversed(names):
        out = F.when(t == a, name).otherwise(out)
    return F.when(t != "", out)


def _by_prefix(raw: Column, catalog: Catalog) -> Column:
    return F.when(raw.rlike(r"(?i)^gd[\s._-]") | raw.rlike(r"(?i)^gd[a-z0-9]"), label(catalog[0]))


def detected(name: Column, hint: Column | None = None, extra: Column | None = None, catalog: Catalog = CATALOG) -> Column:
    """struct(label, source, confidence) of the tracked alliance that name, hint or extra text shows, in this order; in
    each a bracketed tag, then an alias, then a weak prefix. Null label if there is none."""
    label_, source, conf = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("double")
    for text, kind, sure in reversed([(name, "name-tag", 0.98), (hint, "alliance-hint", 0.93), (extra, "text-alias", 0.85)]):
        if text is None:
            continue
        raw = F.trim(F.coalesce(text, F.lit("")))
        for by, less in ((_by_prefix, None), (_by_alias, 0.05), (_by_bracket, 0.0)):
            hit = F.when(raw != "", by(raw, catalog))
            c = max(0.5, sure - 0.38) if less is None else sure - less
            label_, source, conf = F.coalesce(hit, label_), F.when(hit.isNotNull(), kind).otherwise(source), F.when(hit.isNotNull(), F.lit(round(c, 2))).otherwise(conf)
    return F.struct(label_.alias("label"), source.alias("source"), conf.alias("confidence"))


def stripped(name: Column, catalog: Catalog = CATALOG) -> Column:
    """A (sanitized) name without the tag of a tracked alliance before it, however noisy."""
    lead = F.regexp_replace(F.coalesce(name, F.lit("")), r"^[^A-Za-z0-9\[(]+", "")
    bracket = r"^[\[(]\s*([A-Za-z0-9][A-Za-z0-9 ._-]{1,11})\s*[\])]?\s*(.+)$"
    rest = F.trim(F.regexp_replace(F.regexp_extract(lead, bracket, 2), r"^[\s._\-:|/\\]+", ""))
    out = lead
    loose = {"O": "[O0]", "I": "[I1]", "S": "[S5]"}
    for e in reversed(catalog):
        pattern = "(?i)^" + "[^A-Za-z0-9]*".join(loose.get(c, c) for c in token(e[0])) + r"[\s._\-:|/\\]+(.+)$"
        out = F.when(lead.rlike(pattern), F.trim(F.regexp_extract(lead, pattern, 1))).otherwise(out)
    tags = [token(e[0]) for e in catalog]
    return F.when(lead.rlike(bracket) & token(F.regexp_extract(lead, bracket, 1)).isin(tags), rest).otherwise(out)


def filter_labels(wanted: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """(seq, raw) -> labels to filter by: tracked labels where one is meant, without repeats, in order. Few rows."""
    clean = wanted.withColumn("value", F.coalesce(detected(F.col("raw"), F.col("raw"), catalog=catalog)["label"], F.trim("raw"))).withColumn("key", token(F.col("value")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    return clean.filter("key <> ''").withColumn("_n", first).filter("_n = 1").select("seq", "value")


def _header(text: Column, names: dict[str, str], drop: str, default: str) -> Column:
    c = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9 ]", " "), r"\s+", " "))
    c = F.lower(F.trim(F.regexp_replace(c, drop, ""))) if drop else F.lower(c)
    slug = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = F.when(slug == "", default).otherwise(slug)
    for pattern, name in reversed(list(names.items())):
        out = F.when(c.contains(pattern), name).otherwise(out)
    return F.when(c == "", default).otherwise(out)


def board_header(text: Column) -> Column:
    """The board that a noisy header names."""
    return _header(text, BOARD_HEADERS, "RANKINGS?", "unknown")


def metric_header(text: Column) -> Column:
    """The metric that a noisy column label names."""
    return _header(text, METRIC_HEADERS, "", "metric")


def board_tokens(text: Column) -> Column:
    """P5: which boards' tokens a header holds, also where its spaces are lost."""
    up = F.upper(F.coalesce(text, F.lit("")))
    close = F.regexp_replace(up, r"\s+", "")
    return F.array_compact(F.array(*[F.when(up.contains(t) | close.contains(t.replace(" ", "")), t) for t in BOARD_TOKENS]))


def subtitle(text: Column) -> Column:
    """struct(alliance, title): a subtitle that begins with a title is one, others name an alliance."""
    t = F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    title = low.isin(TITLES)
    for h in TITLES:
        title = title | low.startswith(h + " ")
    return F.struct(F.when((t != "") & ~title, t).alias("alliance"), F.when((t != "") & title, t).alias("title"))


def cleaned_name(name: Column) -> Column:
    """P10: a captured name with runs of signs cut, and O/0, I/1, S/5 put right between digits or letters."""
    c = F.regexp_replace(F.coalesce(name, F.lit("")), r"([|*_-])\1{2,}", "$1")
    for pattern, by in ((r"[|*_-]{3,}", " "), (r"(?<=\d)[OQ](?=\d)", "0"), (r"(?<=\d)[I|L](?=\d)", "1"), (r"(?<=[A-Za-z])0(?=[A-Za-z])", "O"), (r"(?<=[A-Za-z])1(?=[A-Za-z])", "l"), (r"(?<=\d)S(?=\d)", "5"), (r"(?<=[A-Za-z])5(?=[A-Za-z])", "S"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


def canonical_alliances(rows: DataFrame, players: DataFrame, catalog: Catalog = CATALOG) -> DataFrame:
    """``rows`` (linked, alliance_raw) with the alliance to show: the tracked one of the linked player (player, name,
    alliance; the raw text helps), else the player's own, else the raw one; without a known player the raw one."""
    known = players.select(F.col("player").alias("linked"), F.col("name").alias("_name"), F.col("alliance").alias("_own"), F.lit(True).alias("_known"))
    none = lambda c: F.when(F.trim(c) != "", c)
    tracked = F.coalesce(detected(F.col("_name"), F.col("_own"), catalog=catalog)["label"], detected(F.lit(None).cast("string"), F.col("alliance_raw"), catalog=catalog)["label"])
    raw = none(F.col("alliance_raw"))
    out = rows.join(known, "linked", "left").withColumn("alliance", F.when(F.col("_known"), F.coalesce(tracked, F.trim(none(F.col("_own"))), raw)).otherwise(raw))
    return out.drop("_name", "_own", "_known")
