"""Extractions: parsed fields, validation, severity, approved payloads, queues and quality figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions.text import FIELD_LIMITS, percent

FIELDS = ["governorId", "governorName", "power", "killPoints", "t4Kills", "t5Kills", "deads"]
#: Least, most, and whether the field may be missing.
BOUNDS = {"power": (100_000, 3_000_000_000, False), "killPoints": (0, 5_000_000_000, False), "t4Kills": (0, 2_000_000_000, True), "t5Kills": (0, 2_000_000_000, True), "deads": (0, 2_000_000_000, True)}

#: Fixed value: signs that a name may hold.
NAME_SIGNS = r"""[A-Za-z0-9 _\-\[\]()#.'":|/\\*+&!?@,`~^]"""


def parsed_fields(rows: DataFrame) -> DataFrame:
    """Fields of JSON columns ``normalized`` or else ``fields``: scalar or {value, confidence}; raw columns stand in for
    missing id and name, the row's confidence for a missing one. Adds ``<field>`` and ``<field>_conf``."""
    base = F.when(F.trim("normalized").startswith("{"), F.col("normalized")).otherwise(F.col("fields"))
    rows = rows.withColumn("_j", F.from_json(base, "map<string,string>"))
    shared = percent(F.col("confidence"))
    stand_in = {"governorId": F.col("governor_id_raw"), "governorName": F.col("governor_name_raw")}
    out = {}
    for f in FIELDS:
        raw = F.element_at("_j", f)
        obj = raw.startswith("{")
        value = F.when(obj, F.get_json_object(raw, "$.value")).otherwise(raw)
        conf = F.when(obj, F.get_json_object(raw, "$.confidence").try_cast("double"))
        out[f] = F.coalesce(value, stand_in.get(f, F.lit(None).cast("string")), F.lit(""))
        out[f"{f}_conf"] = F.coalesce(F.when(conf.isNotNull(), percent(conf)), shared)
    return rows.withColumns(out).drop("_j")


#: What the checks call the fields.
LABELS = {"power": "Power", "killPoints": "Kill Points", "t4Kills": "T4 Kills", "t5Kills": "T5 Kills", "deads": "Deads"}


def field_checks(rows: DataFrame, cross: bool = True) -> DataFrame:
    """(id, field, value, valid, severity, warning) of the id, the name (if there is such a column) and the numeric fields, a
    row each. With ``cross``, kill points below the sum of both kinds of kills are a warning, whatever else they are."""
    names = ["governorId", *(["name"] if "name" in rows.columns else []), *BOUNDS]
    d = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^0-9]", "")
    number = lambda c: F.coalesce(d(c).try_cast("double"), F.lit(0.0))
    less = number("killPoints") < number("t4Kills") + number("t5Kills") if cross else F.lit(False)
    long = rows.withColumn("_less", less).unpivot(["id", "_less"], names, "field", "value").withColumn("_d", d("value"))
    n, whole = F.coalesce(F.col("_d").try_cast("double"), F.lit(0.0)), F.format_number(F.col("_d").try_cast("double"), 0)
    checks = {}  # of each field: valid, severity, warning
    ok = F.length("_d").between(6, 12)
    checks["governorId"] = ok, F.when(ok, "ok").otherwise("error"), F.when(~ok, "Governor ID should be 6-12 digits")
    name = F.trim(F.coalesce("value", F.lit("")))
    known = name.rlike("^" + NAME_SIGNS + "{1,40}$")
    checks["name"] = known, F.when(known, "ok").otherwise("warning"), F.when(F.length(name) < 1, "Name is empty").when(F.length(name) > 40, "Name seems too long").when(~known, "Name contains unsupported characters for English-only OCR mode")
    for f, (low, high, optional) in BOUNDS.items():
        none, zero, label = F.col("_d") == "", (F.lit(f) == "power") & (n <= 0), LABELS[f]
        own = F.when(none, "ok" if optional else "error").when(zero, "error").when((n < low) | (n > high), "warning").otherwise("ok")
        said = lambda how, label=label: F.concat(F.lit(f"{label} ("), whole, F.lit(f") seems too {how}"))
        why = F.when(none, F.lit(None if optional else f"{label} could not be parsed as a number").cast("string")).when(zero, "Power is zero or missing").when(n < low, said("low")).when(n > high, said("high"))
        if f == "killPoints":
            own, why = F.when(F.col("_less"), "warning").otherwise(own), F.when(F.col("_less"), "Kill points less than T4+T5 sum — check values").otherwise(why)
        checks[f] = n.between(low, high), own, why
    out = [F.lit(None).cast(t) for t in ("boolean", "string", "string")]
    for f in names:
        out = [F.when(F.col("field") == f, own).otherwise(rest) for own, rest in zip(checks[f], out, strict=True)]
    return long.select("id", "field", "value", out[0].alias("valid"), out[1].alias("severity"), out[2].alias("warning"))


def trailing_days(rows: DataFrame, now: Column, days: int | None = None, at: str = "created_at") -> DataFrame:
    """rows of the last ``days`` days: 30 unless given, 1 to 180."""
    return rows.filter(F.col(at) >= now - F.make_dt_interval(F.lit(max(1, min(180, 30 if days is None else days)))))


def severity(status: Column, low_confidence: Column, min_conf: Column, errors: Column, warnings: Column) -> Column:
    """HIGH, MEDIUM or LOW."""
    return F.when(status == "REJECTED", "LOW").when(low_confidence | (errors > 0) | (min_conf < 55), "HIGH").when((warnings > 0) | (min_conf < 75), "MEDIUM").otherwise("LOW")


def severity_reasons(status: Column, low_confidence: Column, min_conf: Column, errors: Column, warnings: Column, failures: Column) -> Column:
    """Why, as an array of sentences; ``failures``: an array of the engine's own reasons, of which three are named."""
    healthy = ~low_confidence & (errors == 0) & (warnings == 0) & (min_conf >= 75)
    percent_ = F.floor(min_conf + 0.5).cast("int").cast("string")
    listed = F.array_compact(F.coalesce(failures, F.array().cast("array<string>")))
    return F.when(status == "REJECTED", F.array(F.lit("Marked as rejected."))).otherwise(F.array_compact(F.array(
        F.when(low_confidence, "Engine marked this extraction as low-confidence."),
        F.when(F.size(listed) > 0, F.concat(F.lit("OCR failure reasons: "), F.array_join(F.slice(listed, 1, 3), ", "), F.lit("."))),
        F.when(min_conf < 55, F.concat(F.lit("Very low confidence field ("), percent_, F.lit("%)."))).when(min_conf < 75, F.concat(F.lit("Low confidence field ("), percent_, F.lit("%)."))),
        F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" validation error(s)."))), F.when(warnings > 0, F.concat(warnings.cast("string"), F.lit(" validation warning(s)."))),
        F.when(healthy, "OCR confidence and validation are healthy."),
    )))


def number_of(text: Column) -> Column:
    """The number that the digits of ``text`` spell; 0 without any, null for one that a long does not hold."""
    d = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9-]", "")
    return F.when(d.rlike("^-?[0-9]+$"), d.try_cast("long")).otherwise(0)


def approved_payload(rows: DataFrame) -> DataFrame:
    """Digits of the id, the trimmed name (``Unknown`` if empty), numbers of the metrics."""
    return rows.select("id", F.regexp_replace("governorId", "[^0-9]", "").alias("player"), F.when(F.trim("governorName") == "", "Unknown").otherwise(F.trim("governorName")).alias("name"), *[number_of(F.col(f)).alias(c) for f, c in (("power", "power"), ("killPoints", "kp"), ("t4Kills", "t4"), ("t5Kills", "t5"), ("deads", "deads"))])


def combat_cleanup(rows: DataFrame, least: float = 75.0, most_digits: int = 12) -> DataFrame:
    """t4, t5 and deads are 0 where their confidence is below ``least``, they have over ``most_digits`` digits, or they cannot
    fit kill points or power; ``notes`` says so, an array in the order of these rules."""
    names = {"t4": "t4Kills", "t5": "t5Kills", "deads": "deads"}
    low, long = {}, {}
    for c, name in names.items():
        conf = F.coalesce(F.col(f"{c}_conf"), F.lit(0.0))
        poor = (conf < least) & (F.col(c) > 0)
        much = ~poor & (F.col(c) > 0) & (F.length(F.col(c).cast("string")) > most_digits)
        low[f"_l_{c}"] = F.when(poor, F.concat(F.lit(f"{name} reset to 0 (low confidence "), F.floor(conf + 0.5).cast("int").cast("string"), F.lit("%)")))
        long[f"_d_{c}"] = F.when(much, f"{name} reset to 0 (implausible digit length)")
    rows = rows.withColumns(low | long).withColumns({c: F.when(F.col(f"_l_{c}").isNotNull() | F.col(f"_d_{c}").isNotNull(), 0).otherwise(F.col(c)) for c in names})
    over = F.coalesce((F.col("kp") > 0) & (F.col("t4") + F.col("t5") > F.col("kp") * 3), F.lit(False))
    dead = F.coalesce((F.col("power") > 0) & (F.col("deads") > F.col("power") * 2), F.lit(False))
    rows = rows.withColumns({"_over": over, "_dead": dead})
    notes = F.array_compact(F.array(*[F.col(n) for n in (*low, *long)], F.when(F.col("_over"), "t4/t5 reset to 0 (implausible vs kill points)"), F.when(F.col("_dead"), "deads reset to 0 (implausible vs power)")))
    rows = rows.withColumns({"notes": notes, "t4": F.when(F.col("_over"), 0).otherwise(F.col("t4")), "t5": F.when(F.col("_over"), 0).otherwise(F.col("t5")), "deads": F.when(F.col("_dead"), 0).otherwise(F.col("deads"))})
    return rows.drop(*low, *long, "_over", "_dead")


def limit_problems(rows: DataFrame) -> DataFrame:
    """P25: (id, field, reason) of numeric fields out of their limits."""
    from boardlake.functions.text import field_problem

    long = rows.unpivot(["id"], list(FIELD_LIMITS), "field", "value")
    return long.select("id", "field", field_problem(F.col("field"), F.col("value")).alias("reason")).filter("reason is not null")


def quality_figures(extractions: DataFrame, corrections: DataFrame, since: Column | None = None) -> DataFrame:
    """One row: extractions, those reviewed, approved, rejected and of low confidence, corrections, extractions that were
    corrected, and the rates of approvals, of low confidence and of corrections to extractions (0 without extractions); F7: from
    ``since`` on."""
    if since is not None:
        extractions, corrections = extractions.filter(F.col("created_at") >= since), corrections.filter(F.col("created_at") >= since)
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = extractions.agg(F.count("*").alias("total"), of("REVIEWED", "APPROVED", "REJECTED").alias("reviewed"), of("APPROVED").alias("approved"), of("REJECTED").alias("rejected"), F.count_if("low_confidence").alias("low_confidence"))
    fixes = corrections.agg(F.count("*").alias("corrections"), F.count_distinct("id").alias("corrected"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("total")), F.lit(0.0)), 6)
    both = counts.crossJoin(fixes)  # one row each
    return both.withColumns({"approval_rate": rate("approved"), "low_confidence_rate": rate("low_confidence"), "edit_rate": rate("corrections")})


def profile_figures(extractions: DataFrame, since: Column | None = None) -> DataFrame:
    """Per profile (``unassigned`` without one) extractions, those of low confidence, and their rate."""
    own = extractions if since is None else extractions.filter(F.col("created_at") >= since)
    g = own.groupBy(F.coalesce("profile", F.lit("unassigned")).alias("profile")).agg(F.count("*").alias("total"), F.count_if("low_confidence").alias("low_confidence"))
    return g.withColumn("low_confidence_rate", F.round(F.col("low_confidence") / F.col("total"), 6))


def corrections_by(corrections: DataFrame) -> DataFrame:
    """Corrections by field and by reason (``unspecified`` without one), and how many extractions they touch: by, value, n,
    extractions."""
    rows = corrections.select("id", "field", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unspecified")).alias("reason"))
    g = rows.groupingSets([["field"], ["reason"]], "field", "reason").agg(F.grouping("field").alias("_g"), F.count("*").alias("n"), F.count_distinct("id").alias("extractions"))
    return g.select(F.when(F.col("_g") == 0, "field").otherwise("reason").alias("by"), F.when(F.col("_g") == 0, F.col("field")).otherwise(F.col("reason")).alias("value"), "n", "extractions")


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", ""))


def golden(cases: DataFrame) -> DataFrame:
    """Per case fields that mismatch, fields that match with too low a confidence, whether the mean confidence is below the case's
    least one, that mean, and whether the case passed, which is none of these.

    ``cases``: case, field, expected, actual, confidence, least, least_mean, numeric. White space and case don't count.
    """
    same = _plain(F.col("expected")) == _plain(F.col("actual"))
    g = cases.groupBy("case").agg(F.count_if(~same).alias("mismatches"), F.count_if(same & (F.col("confidence") < F.col("least"))).alias("low"), F.avg("confidence").alias("_mean"), F.max("least_mean").alias("_least"))
    g = g.withColumn("low_mean", F.coalesce(F.col("_mean") < F.col("_least"), F.lit(False)))
    passed = (F.col("mismatches") == 0) & (F.col("low") == 0) & ~F.col("low_mean")
    return g.select("case", "mismatches", "low", "low_mean", F.round("_mean", 4).alias("confidence"), passed.alias("passed"))


def golden_suite(cases: DataFrame, least: float = 0.98) -> DataFrame:
    """One row: cases, passed and failed ones, numeric fields, those with equal digits, their rate (1 without any) and whether it is
    at least ``least``."""
    digits = lambda c: F.regexp_replace(_plain(F.col(c)), "[^0-9]", "")
    own = F.col("numeric")
    numbers = cases.agg(F.count_if(own).alias("numeric_total"), F.count_if(own & (digits("expected") == digits("actual"))).alias("numeric_exact"))
    per = golden(cases).agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    rate = F.coalesce(F.try_divide("numeric_exact", "numeric_total"), F.lit(1.0))
    both = per.crossJoin(numbers)  # one row each
    return both.withColumns({"numeric_rate": F.round(rate, 6), "numeric_passed": rate >= least})


def review_queue(rows: DataFrame, players: DataFrame, snapshots: DataFrame, backlog: DataFrame) -> DataFrame:
    """Extraction rows (id, status, event, and a text for each field) beside what is known: the player by the digits of the
    id, the player's snapshot (player, event, power, kp, t4, t5, deads) of the same event, and the row of the backlog
    (id, linked_event, sync_status, last_error) that waits for synchronisation. ``previous``: by field; ``changed``: the fields
    whose known value differs from the text, in order, comma-joined."""
    numbers = {"power": "power", "killPoints": "kp", "t4Kills": "t4", "t5Kills": "t5", "deads": "deads"}
    known = rows.withColumn("player", F.regexp_replace("governorId", "[^0-9]", "").try_cast("long")).join(players.select("player", F.col("name").alias("known_name"), F.lit(True).alias("_known")), "player", "left")
    snaps = snapshots.select("player", "event", *[F.col(c).cast("string").alias(f"_{c}") for c in numbers.values()])
    waiting = backlog.select("id", "linked_event", "sync_status", "last_error")
    out = known.join(snaps, ["player", "event"], "left").join(waiting, "id", "left")
    previous = {"governorId": F.when(F.col("_known"), F.col("player").cast("string")), "governorName": F.col("known_name"), **{f: F.col(f"_{c}") for f, c in numbers.items()}}
    changed = F.concat_ws(",", *[F.when((v != "") & (v != F.coalesce(F.col(f), F.lit(""))), f) for f, v in previous.items()])
    pending = F.coalesce(F.col("sync_status").isin("PENDING", "PROCESSING", "FAILED"), F.lit(False))
    state = F.when(F.col("status") == "APPROVED", F.when(pending | F.col("event").isNull(), "PENDING_WEEK_LINK").otherwise("SYNCED"))
    return out.select(
        *rows.columns, F.struct(*[v.alias(f) for f, v in previous.items()]).alias("previous"), changed.alias("changed"), state.alias("sync_state"),
        F.coalesce("linked_event", "event").alias("linked_event"), F.when(pending, F.col("last_error")).alias("sync_message"),
    )


def repaired_ids(rows: DataFrame, players: DataFrame) -> DataFrame:
    """Payloads (id, player text, name, alias_key) with the player's id put right from the registry (player text, name,
    alias_key): an id that is none (6 to 12 digits) becomes that of the player with the same name, without regard to case (the
    smallest of several), or null if there is none; a sound id that nobody has becomes that of the one player of the same name
    and alias key. ``repair``: kept, by-name, by-alias or invalid."""
    sound = lambda c: F.coalesce(F.col(c).rlike("^[0-9]{6,12}$"), F.lit(False))
    reg = players.select(F.col("player").alias("_p"), F.lower("name").alias("_n"), F.col("alias_key").alias("_k"))
    by_name = reg.groupBy("_n").agg(F.min("_p").alias("_named"))
    by_alias = reg.groupBy("_n", F.col("_k").alias("alias_key")).agg(F.count("*").alias("_c"), F.min("_p").alias("_only"))
    ids = reg.select(F.col("_p").alias("player")).distinct().withColumn("_has", F.lit(True))
    out = rows.withColumn("_n", F.lower("name")).join(by_name, "_n", "left").join(by_alias, ["_n", "alias_key"], "left").join(ids, "player", "left")
    named = F.when(sound("_named"), F.col("_named"))
    alias = F.when(F.col("_has").isNull() & (F.col("_c") == 1) & sound("_only") & ~F.coalesce("alias_key", F.lit("")).isin("", "unknown"), F.col("_only"))
    repaired = F.when(~sound("player"), named).otherwise(F.coalesce(alias, "player"))
    how = F.when(~sound("player"), F.when(named.isNotNull(), "by-name").otherwise("invalid")).when(alias.isNotNull() & (alias != F.col("player")), "by-alias").otherwise("kept")
    return out.select(*[c for c in rows.columns if c != "player"], repaired.alias("player"), how.alias("repair"))


def queue_page(rows: DataFrame, level: str | None, by: str, offset: int, limit: int) -> DataFrame:
    """A page of the queue, newest or least confident first."""
    own = rows.filter(F.col("severity") == level) if level else rows
    order = [F.asc("confidence"), F.asc("id")] if by == "confidence" else [F.desc("created_at"), F.asc("id")]
    return own.orderBy(*order).offset(offset).limit(limit)


def queue_summary(rows: DataFrame) -> DataFrame:
    """How many rows there are of each severity."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return rows.agg(F.count("*").alias("total"), n("HIGH"), n("MEDIUM"), n("LOW"))


def read_severity(status: Column, low_confidence: Column, failures: Column, confidence: Column) -> Column:
    """N4, as lists of profiles show it: HIGH for RAW rows of low confidence and for any reason of failure, MEDIUM for low confidence
    otherwise or below 70, else LOW."""
    any_ = F.size(F.coalesce(failures, F.array().cast("array<string>"))) > 0
    low = F.coalesce(low_confidence, F.lit(False))
    return F.when(((status == "RAW") & low) | any_, "HIGH").when(low | (confidence < 70), "MEDIUM").otherwise("LOW")


def timeline(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """Each player's snapshots in order of event time, with their place and the change of power."""
    w = Window.partitionBy("player").orderBy("at", "event")
    out = snapshots.join(events, "event")
    return out.withColumns({"place": F.row_number().over(w), "power_change": F.col("power") - F.lag("power").over(w)})


def scored_candidates(cands: DataFrame) -> DataFrame:
    """Candidates (ext, field, id, value text, confidence 0 to 100, valid, and maybe problem: why it is not) scored by confidence,
    form and validity: names by length and signs, ids and numbers by their digits. Adds the place within the field (by score,
    confidence, id), and for the selected one the reasons to doubt it, or ``selected-highest-fusion-score``, comma-joined, and
    whether there are any (``low_confidence``). An invalid one tells its problem, or ``validation-failed``."""
    value = F.coalesce(F.col("value"), F.lit(""))
    n, digits = F.length(value), F.length(F.regexp_replace(value, "[^0-9]", ""))
    signs = F.when(n > 0, F.length(F.regexp_replace(value, NAME_SIGNS, "")) / n)
    name = F.when(n.between(1, 40), 0.12).otherwise(-0.18) + F.coalesce((1 - signs) * 0.2, F.lit(0.0)) + F.when(F.col("valid"), 0.1).otherwise(-0.28)
    length = F.when(F.col("field") == "governorId", F.when(digits.between(6, 12), 0.16).otherwise(-0.22)).otherwise(F.when(digits.between(1, 11), 0.08).otherwise(-0.16))
    number = F.when(digits > 0, 0.1).otherwise(-0.45) + length + F.when(F.col("valid"), 0.14).otherwise(-0.35)
    score = F.round(F.col("confidence") / 100 * 0.62 + F.when(F.col("field") == "governorName", name).otherwise(number), 9)
    w = Window.partitionBy("ext", "field").orderBy(F.desc("score"), F.desc("confidence"), "id")
    ranked = cands.withColumn("score", score).withColumns({"place": F.row_number().over(w), "lead": F.round(F.col("score") - F.lead("score").over(w), 9)})
    problem = F.coalesce(F.nullif("problem", F.lit("")), F.lit("validation-failed")) if "problem" in cands.columns else F.lit("validation-failed")
    reasons = F.concat_ws(",", F.when(~F.col("valid"), problem), F.when(F.col("confidence") < 70, "low-ocr-confidence"), F.when(F.col("score") < 0.55, "low-fusion-score"), F.when(F.col("lead") < 0.03, "ambiguous-candidates"))
    first = F.col("place") == 1
    return ranked.withColumns({"reasons": F.when(first, F.when(reasons == "", "selected-highest-fusion-score").otherwise(reasons)), "low_confidence": F.when(first, reasons != "")})


def fused_candidates(cands: DataFrame, alternatives: int = 4) -> DataFrame:
    """The selected candidate of each field and the next best ones, ``alternatives`` in all, as ``scored_candidates`` has them."""
    return scored_candidates(cands).filter(F.col("place") <= alternatives)


def consistent_fields(scored: DataFrame, top: int = 3) -> DataFrame:
    """Of the best three numeric candidates of kp, t4 and t5 (of all ``scored_candidates``, with digits in their value) the
    combination with the largest sum of scores, less 1.25 and the relative excess (2 at most) where kp < t4 + t5; the first in
    order of places of equals. Tells which fields it changes. One grouping, at most 27 combinations an extraction; numbers of up to
    38 digits, longer ones are no candidates."""
    fields = ("kp", "t4", "t5")
    numeric = scored.filter(F.col("field").isin(*fields)).withColumn("n", F.nullif(F.regexp_replace("value", "[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")).filter("n is not null")
    place = F.row_number().over(Window.partitionBy("ext", "field").orderBy("place"))
    kept = numeric.withColumn("_p", place).filter(F.col("_p") <= top)
    best_of = lambda f: F.array_sort(F.collect_list(F.when(F.col("field") == f, F.struct("place", "n", "score")))).alias(f)
    g = kept.groupBy("ext").agg(*[best_of(f) for f in fields]).filter(" and ".join(f"size({f}) > 0" for f in fields))

    def combo(kp: Column, t4: Column, t5: Column) -> Column:
        excess = t4["n"].cast("double") + t5["n"].cast("double") - kp["n"].cast("double")
        over = kp["n"] - t4["n"] < t5["n"]
        penalty = F.when(over, 1.25 + F.least(F.lit(2.0), excess / F.greatest(F.lit(1.0), kp["n"].cast("double")))).otherwise(0.0)
        total = F.round(kp["score"] + t4["score"] + t5["score"] - penalty, 9)
        return F.struct(total.alias("total"), *[(-x["place"]).alias(f"p_{f}") for f, x in zip(fields, (kp, t4, t5), strict=True)], *[x["n"].alias(f) for f, x in zip(fields, (kp, t4, t5), strict=True)], over.alias("inconsistent"))

    every = F.flatten(F.transform("kp", lambda a: F.flatten(F.transform("t4", lambda b: F.transform("t5", lambda c: combo(a, b, c))))))
    best = g.select("ext", F.array_max(every).alias("b"))
    changed = F.concat_ws(",", *[F.when(F.col(f"b.p_{f}") < -1, f"{f}:adjusted-for-consistency") for f in fields])
    return best.select("ext", "b.kp", "b.t4", "b.t5", "b.total", "b.inconsistent", changed.alias("reasons"))


RAW_RANKING = "struct<archetype:string,failureReasons:array<string>,rows:array<struct<rank:string,name:string,metric:string,confidence:double>>>"


def ranking_payload(runs: DataFrame, least: float = 70.0) -> DataFrame:
    """(run, payload JSON) -> typed rows: digits of the metric, printable name, valid rank, percent confidence. Rows
    without a name or a metric go. Adds the archetype (inferred where it is missing), the reasons of failure (distinct, and
    ``no-rows`` without any row) and the flag for low confidence."""
    from boardlake.functions.text import archetype, valid_rank

    p = runs.select("run", F.from_json("payload", RAW_RANKING).alias("p"))
    name = lambda r: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(r["name"], F.lit("")), "[^\\x20-\\x7E]", " "), r"\s+", " "))
    digits = lambda r: F.regexp_replace(F.coalesce(r["metric"], F.lit("")), "[^0-9]", "")
    typed = F.transform(F.coalesce("p.rows", F.array().cast("array<struct<rank:string,name:string,metric:string,confidence:double>>")), lambda r: F.struct(valid_rank(r["rank"].try_cast("double")).alias("rank"), name(r).alias("name"), digits(r).alias("metric"), percent(r["confidence"]).alias("confidence")))
    rows = F.filter(typed, lambda r: (r["name"] != "") & (r["metric"] != ""))
    p = p.withColumn("rows", rows)
    kind = archetype(F.coalesce("p.archetype", F.when(F.size("rows") > 0, "ranking")))
    reasons = F.array_distinct(F.array_compact(F.concat(F.coalesce("p.failureReasons", F.array().cast("array<string>")), F.array(F.when(F.size("rows") == 0, "no-rows")))))
    low = F.exists("rows", lambda r: r["confidence"] < least) | (F.size(reasons) > 0)
    return p.select("run", kind.alias("archetype"), F.array_join(reasons, ",").alias("reasons"), low.alias("low_confidence"), F.posexplode_outer("rows").alias("at", "r")).select("run", "archetype", "reasons", "low_confidence", "at", "r.*")


PROFILE = "struct<governorId:string,governorName:string,power:string,killPoints:string,t4Kills:string,t5Kills:string,deads:string,alliance:string,confidence:double,failureReasons:array<string>>"


def _printable(c: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\x20-\\x7E]", " "), r"\s+", " ")), 1, most)


def profile_payload(rows: DataFrame, least: float = 75.0) -> DataFrame:
    """(id, payload JSON) -> typed profile fields: digits of ids (16 at most) and metrics (18), printable names (80), percent
    confidence, distinct reasons, and the flag for low confidence: below ``least``, or without id, name, power or kill points."""
    e = rows.select("id", F.from_json("payload", PROFILE).alias("p"))
    digits = lambda f, most=18: F.substring(F.regexp_replace(F.coalesce(F.col(f"p.{f}"), F.lit("")), "[^0-9]", ""), 1, most).alias(f)
    reasons = F.filter(F.transform(F.array_distinct(F.array_compact(F.coalesce("p.failureReasons", F.array().cast("array<string>")))), lambda r: _printable(r, 220)), lambda r: r != "")
    out = e.select("id", digits("governorId", 16), _printable(F.col("p.governorName"), 80).alias("governorName"), *[digits(f) for f in FIELDS[2:]], _printable(F.col("p.alliance"), 80).alias("alliance"), percent(F.coalesce("p.confidence", F.lit(0.0))).alias("confidence"), F.array_join(reasons, ",").alias("reasons"))
    missing = [F.col(c) == "" for c in ("governorId", "governorName", "power", "killPoints")]
    return out.withColumn("low_confidence", (F.col("confidence") < least) | missing[0] | missing[1] | missing[2] | missing[3])


def _member(v: Column, name: str, kinds: str) -> Column:
    """A member of a variant object if its own type is one of ``kinds``, as a variant."""
    own = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(own).rlike(f"^({kinds})"), own)


def run_diagnostics(metadata: Column) -> Column:
    """What a run's JSON metadata tell of its capture, as a struct; null without any of it. Numbers must be numbers (counts
    are cut to whole ones, 0 at least), of lists the first 12 texts that are not blank count."""
    v = F.try_parse_json(metadata)
    number = lambda n: F.try_variant_get(_member(v, n, "BIGINT|DECIMAL|DOUBLE|FLOAT"), "$", "double")
    count = lambda n: F.when(number(n).isNotNull(), F.greatest(F.lit(0), F.floor(number(n)))).cast("long")
    text = lambda e: F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string"))
    listed = lambda n: F.slice(F.filter(F.transform(F.coalesce(F.try_variant_get(_member(v, n, "ARRAY"), "$", "array<variant>"), F.array().cast("array<variant>")), text), lambda e: F.trim(e) != ""), 1, 12)
    parts = {
        "classification_confidence": number("classificationConfidence"), "dropped_rows": count("droppedRowCount"), "guard_failures": listed("guardFailures"), "board_tokens": listed("detectedBoardTokens"),
        "uniformity": F.to_json(_member(v, "uniformity", "OBJECT")), "worker": F.try_variant_get(_member(v, "worker", "STRING"), "$", "string"), "duration_ms": count("ocrDurationMs"), "slots": count("slotCount"),
        "detected_rows": count("detectedRows"), "valid_rows": count("validRows"),
    }
    some = F.lit(False)
    for name, c in parts.items():
        some = some | (F.size(c) > 0 if name in ("guard_failures", "board_tokens") else c.isNotNull())
    return F.when(some, F.struct(*[c.alias(n) for n, c in parts.items()]))


def identity_suggestions(candidates: Column, most: int = 8) -> Column:
    """The first ``most`` suggestions in JSON candidates, as an array of (id, game_id, name, source): objects that have an id, a
    game id and a name (trimmed), which are texts and not empty, and the source alias or name; each id once."""
    items = F.coalesce(F.try_variant_get(_member(F.try_parse_json(candidates), "identitySuggestions", "ARRAY"), "$", "array<variant>"), F.array().cast("array<variant>"))
    text = lambda e, n: F.coalesce(F.try_variant_get(_member(e, n, "STRING"), "$", "string"), F.lit(""))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    typed = F.transform(items, lambda e: F.struct(text(e, "governorId").alias("id"), text(e, "governorGameId").alias("game_id"), trimmed(text(e, "name")).alias("name"), text(e, "source").alias("source")))
    whole = F.filter(typed, lambda e: (e["id"] != "") & (e["game_id"] != "") & (e["name"] != "") & e["source"].isin("alias", "name"))
    add = lambda got, e: F.when((F.size(got) < most) & ~F.exists(got, lambda x: x["id"] == e["id"]), F.concat(got, F.array(e))).otherwise(got)
    none = F.array().cast("array<struct<id:string,game_id:string,name:string,source:string>>")
    return F.aggregate(whole, none, add)  # named once, as each mention of ``whole`` would parse the JSON again


#: Under which names a cell may come, in order of preference.
CELLS = {
    "rank": ["sourceRank", "rank", "position"],
    "player": ["governorNameRaw", "governorName", "name", "governorNameNormalized"],
    "player_id": ["governorId", "governorGameId", "governorDbId", "linkedGovernorId"],
    "alliance": ["allianceRaw", "alliance", "linkedAlliance", "allianceTag"],
    "kp": ["killPoints", "kp", "killPoint", "killpoints", "currentKillPoints", "totalKillPoints", "kpRaw", "deltaKillPoints"],
    "power": ["power", "currentPower", "totalPower", "powerRaw", "powerValue", "deltaPower"],
    "metric": ["metricValue", "metricRaw", "deltaKillPoints", "deltaPower", "deltaDeads", "score"],
    "confidence": ["confidence", "identityConfidence"],
}


def analysis_rows(reads: DataFrame, a_read: int = 40, most: int = 20) -> DataFrame:
    """Rows of unlike shape (plan, read, at, row JSON) as one table of text cells: each takes the first of its names that
    holds something (no null, empty text, 0 or false), else the metric if that is of its kind, else ``-``. The first ``a_read``
    rows of a read and the first ``most`` rows of a plan that name a player count."""
    every = list(dict.fromkeys(["metricValue", "metricRaw", *[n for names in CELLS.values() for n in names]]))
    held = F.array(*[F.try_variant_get(F.col("_v"), f"$.{name}", "variant") for name in every])
    typed = F.transform(held, lambda v: F.struct(F.try_variant_get(v, "$", "string").alias("text"), F.schema_of_variant(v).alias("type")))

    def something(x: Column) -> Column:
        """The text, unless it is null, empty text, the number 0 or false."""
        nothing = (x["text"] == "") | ((x["type"] == "BOOLEAN") & (x["text"] == "false")) | (x["type"].rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (x["text"].try_cast("double") == 0))
        return F.when(~nothing, x["text"])

    some = lambda name: F.col("_some")[every.index(name)]
    kind = F.lower(F.trim(F.coalesce(F.col("_kind"), F.lit(""))))
    metric = F.coalesce(some("metricValue"), some("metricRaw"))
    own = {"power": F.when(kind.contains("power"), metric), "kp": F.when(kind.contains("kill") | kind.contains("kp"), metric)}
    shown = lambda c: F.coalesce(F.nullif(F.substring(F.trim(F.regexp_replace(c, r"[\s\p{C}]+", " ")), 1, 120), F.lit("")), F.lit("-"))
    cells = {name: shown(F.coalesce(*map(some, names), *([own[name]] if name in own else []))) for name, names in CELLS.items()}
    in_read, in_plan = Window.partitionBy("plan", "read").orderBy("at"), Window.partitionBy("plan").orderBy("read", "at")
    rows = reads.withColumn("_n", F.row_number().over(in_read)).filter(F.col("_n") <= a_read).withColumn("_v", F.try_parse_json("row"))
    rows = rows.select("plan", "read", "at", F.transform(typed, something).alias("_some"), F.try_variant_get(F.col("_v"), "$.metricKey", "string").alias("_kind"))
    # cells leave a generator, beyond which the filter is not pushed: it would name all they are made of again
    rows = rows.select("plan", "read", "at", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cells.items()]))))
    rows = rows.filter((F.col("player") != "-") | (F.col("player_id") != "-"))
    return rows.withColumn("place", F.row_number().over(in_plan)).filter(F.col("place") <= most)
