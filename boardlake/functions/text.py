"""Scalar expressions over noisy text: board and metric names, digits, confidences, labels. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which boards and metrics come in, and the metric that a board must have.
BOARD_NAMES = {
    "individual_power": "individual_power", "individualpower": "individual_power", "mad_scientist": "mad_scientist",
    "madscientist": "mad_scientist", "fort_destroyer": "fort_destroyer", "fortdestroyer": "fort_destroyer",
    "fort_destroy": "fort_destroyer", "fort_destroying": "fort_destroyer", "governor_profile_power": "governor_profile_power",
    "governor_profile": "governor_profile_power", "kill_point": "kill_point", "kill_points": "kill_point",
    "killpoint": "kill_point", "killpoints": "kill_point",
}
METRIC_NAMES = {
    "power": "power", "contribution_points": "contribution_points", "contribution": "contribution_points",
    "tech_contribution": "contribution_points", "fort_destroying": "fort_destroying", "fort_destroy": "fort_destroying",
    "fort": "fort_destroying", "destroy": "fort_destroying", "kill_points": "kill_points", "kill_point": "kill_points",
    "kp": "kill_points",
}
BOARD_METRIC = {"individual_power": "power", "mad_scientist": "contribution_points", "fort_destroyer": "fort_destroying", "kill_point": "kill_points"}
BOARD_LABELS = {"individual_power": "Power Rankings", "mad_scientist": "Mad Scientist", "fort_destroyer": "Fort Destroyer", "kill_point": "Kill Points"}
METRIC_LABELS = {"power": "Power", "contribution_points": "Contribution Points", "fort_destroying": "Fort Destroying", "kill_points": "Kill Points"}
EVENT_LABELS = {"KVK_START": "KvK", "KVK_END": "KvK", "MGE": "MGE", "OSIRIS": "Ark of Osiris", "WEEKLY": "Weekly Check", "CUSTOM": "Custom"}
SYSTEM_EVENTS, LEGACY_EVENTS = ["WEEKLY"], ["KVK_END", "CUSTOM"]


def lookup(names: dict[str, str], key: Column) -> Column:
    """``names[key]``, null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def _slug(text: Column, default: str) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", default).otherwise(s)


def collapsed(text: Column) -> Column:
    """Trimmed, with runs of white space as one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def board_type(text: Column) -> Column:
    base = _slug(F.trim(F.regexp_replace(collapsed(text), "(?i)RANKINGS?$", "")), "unknown")
    return F.coalesce(lookup(BOARD_NAMES, base), base)


def metric_key(text: Column) -> Column:
    base = _slug(collapsed(text), "metric")
    return F.coalesce(lookup(METRIC_NAMES, base), base)


def board_check(board: Column, metric: Column) -> Column:
    """struct(ok, board, metric, expected, reason) of a (board, metric) pair."""
    b, m = board_type(board), metric_key(metric)
    expected = lookup(BOARD_METRIC, b)
    reason = F.when(expected.isNull(), F.concat(F.lit('Unsupported rankingType "'), b, F.lit('".'))).when(
        m != expected, F.concat(F.lit('rankingType "'), b, F.lit('" requires metricKey "'), expected, F.lit('" (received "'), m, F.lit('").'))
    )
    return F.struct(reason.isNull().alias("ok"), b.alias("board"), m.alias("metric"), expected.alias("expected"), reason.alias("reason"))


def repaired_digits(text: Column) -> Column:
    """Digits after repair of letters that stand for digits in noisy captures."""
    return F.regexp_replace(F.translate(F.upper(F.trim(F.coalesce(text, F.lit("")))), "OQDI|LSBGZ", "0001115862"), "[^0-9]", "")


def repaired_number(text: Column) -> Column:
    d = repaired_digits(text)
    return F.when(d == "", F.lit(0).cast("long")).otherwise(d.try_cast("long"))


def metric_evidence(text: Column) -> Column:
    """struct(has_digit, digits (at most 14), grouping_ok): what a captured metric shows.

    Grouping holds if a separated number has a head of one to three characters and tails of three each.
    """
    raw = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.split(F.regexp_replace(raw, "[^0-9,.' ]", ""), "[,.' ]+"), lambda p: p != "")
    grouped = F.size(parts) > 1
    ok = ~grouped | (F.length(F.get(parts, F.lit(0))).between(1, 3) & F.forall(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.length(p) == 3))
    return F.struct(raw.rlike("[0-9]").alias("has_digit"), F.substring(repaired_digits(raw), 1, 14).alias("digits"), ok.alias("grouping_ok"))


def percent(confidence: Column) -> Column:
    """0 to 100: values of at most 1 are shares; others are clamped; what is no number is 0."""
    c = F.when(confidence.isNull() | F.isnan(confidence), 0.0).otherwise(confidence.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(c <= 1, c * 100).otherwise(c)))


def valid_rank(rank: Column) -> Column:
    r = F.floor(rank)
    return F.when(r.between(1, 5000), r.cast("int"))


def identity_key(player: Column, name: Column) -> Column:
    return F.when(player.isNotNull() & (player != ""), F.concat(F.lit("gov:"), player)).otherwise(F.concat(F.lit("name:"), name))


def event_class(kind: Column) -> Column:
    k = F.trim(F.coalesce(kind, F.lit("")))
    return F.when(k.isin(SYSTEM_EVENTS), "system").when(k.isin(LEGACY_EVENTS), "legacy").otherwise("manual")


def event_label(kind: Column) -> Column:
    k = F.trim(F.coalesce(kind, F.lit("")))
    return F.coalesce(lookup(EVENT_LABELS, k), F.when(k == "", "Unknown").otherwise(k))


def title_case(text: Column) -> Column:
    t = collapsed(F.regexp_replace(F.coalesce(text, F.lit("")), "[_-]+", " "))
    return F.when(t == "", "Unknown").otherwise(F.initcap(t))


def board_label(board: Column) -> Column:
    return F.coalesce(lookup(BOARD_LABELS, board), title_case(board))


def metric_label(metric: Column) -> Column:
    return F.coalesce(lookup(METRIC_LABELS, metric), title_case(metric))


def archetype(hint: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(hint, F.lit("")))), "[^a-z0-9]+", "_")
    return F.when(s.contains("profile"), "governor_profile").when(s.contains("ranking"), "ranking_board").otherwise("unknown")


def ingestion_domain(kind: Column) -> Column:
    return F.when(kind == "ranking_board", "RANKING_CAPTURE").otherwise("PROFILE_SNAPSHOT")


def _tenths(x: Column) -> Column:
    """Tenths of ``x`` (0 or more), rounded by the number that the double is, away from 0 on ties. 1.15 is a little less than that, so
    11. A double of 1 or more has no bits below 2^-52, so its fraction is a whole number of those, and all is exact."""
    unit = 1 << 52
    twenty = ((x - F.floor(x)) * float(unit)).cast("long") * 20
    down = F.floor(twenty / F.lit(2 * unit).cast("decimal(20,0)")).cast("long")
    return F.floor(x).cast("long") * 10 + down + F.when(twenty - down * (2 * unit) >= unit, 1).otherwise(0)


def compact(n: Column) -> Column:
    """1234 -> 1.2K, and so on for M and B."""
    def short(by: float, unit: str) -> Column:
        t = _tenths(F.abs(n.cast("double")) / by)
        return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(t / 10).cast("string"), F.when(t % 10 > 0, F.concat(F.lit("."), (t % 10).cast("string"))).otherwise(""), F.lit(unit))

    a = F.abs(n.cast("double"))
    return F.when(a >= 1e9, short(1e9, "B")).when(a >= 1e6, short(1e6, "M")).when(a >= 1e3, short(1e3, "K")).otherwise(n.cast("string"))


def signed_compact(n: Column) -> Column:
    return F.concat(F.when(n > 0, "+").otherwise(""), compact(n))


def correction_reason(field: Column, before: Column, after: Column) -> Column:
    """Why a reviewer may have changed a field."""
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    apart = F.abs(F.length(digits(before)) - F.length(digits(after)))
    number = F.when((digits(before) == "") & (digits(after) != ""), "threshold_failure").when(apart >= 2, "crop_drift").when(apart == 0, "digit_confusion").otherwise("numeric_adjustment")
    name = F.when((F.trim(before) == "") & (F.trim(after) != ""), "name_empty_fix").when(F.abs(F.length(before) - F.length(after)) >= 4, "name_crop_drift").otherwise("name_typo_fix")
    return F.when(before == after, "no_change").when(field == "governorName", name).otherwise(number)


#: Fixed values: (fewest digits, most digits, least, most) of each numeric field.
FIELD_LIMITS = {
    "governorId": (6, 12, 100000, 999999999999), "power": (5, 11, 100000, 3000000000), "killPoints": (1, 11, 0, 5000000000),
    "t4Kills": (1, 10, 0, 2000000000), "t5Kills": (1, 10, 0, 2000000000), "deads": (1, 10, 0, 2000000000),
}


def field_problem(field: Column, text: Column) -> Column:
    """Null if a numeric field's text is within its limits, else the reason."""
    d = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    out = F.lit(None).cast("string")
    for name, (short, long, low, high) in FIELD_LIMITS.items():
        v = d.try_cast("decimal(38,0)")
        own = F.when(d == "", "missing-digits").when(F.length(d) < short, "digits-too-short").when(F.length(d) > long, "digits-too-long").when(v < low, "below-range").when(v > high, "above-range")
        out = F.when(field == name, own).otherwise(out)
    return out
