"""Resolving noisy names to registered players: exact, fuzzy, by embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from boardlake.functions.vectorized import similar_names, similar_players
from boardlake.sources.scratch import written

THRESHOLD, MARGIN, LEAST = 0.93, 0.04, 0.72
SUGGESTIONS = 5


def best_per_player(candidates: DataFrame, k: int = 5) -> DataFrame:
    """U4: per query the best score of each player, the ``k`` best (ties by name, then player)."""
    best = candidates.groupBy("query", "player").agg(F.max_by(F.struct("name", "score", "source"), F.struct("score", F.col("source") == "alias")).alias("b"))
    w = Window.partitionBy("query").orderBy(F.desc("b.score"), "b.name", "player")
    return best.select("query", "player", "b.*", F.row_number().over(w).alias("place")).filter(F.col("place") <= k)


def exact_matches(queries: DataFrame, players: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, player, name, score 1, source): equal alias key, or equal name without regard to case."""
    by_alias = queries.join(aliases, queries.key == aliases.alias_key).join(players.select("player", "name"), "player")
    by_name = queries.withColumn("_n", F.lower("query")).join(players.withColumn("_n", F.lower("name")).select("player", "name", "_n"), "_n")
    mark = lambda df, source: df.select("query", "player", "name", F.lit(1.0).alias("score"), F.lit(source).alias("source"))
    return mark(by_alias, "alias").unionByName(mark(by_name, "name"))


def verdicts(queries: DataFrame, candidates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per query: resolved if one player reaches the threshold, ambiguous if several do, else unresolved; best player."""
    per = candidates.groupBy("query", "player").agg(F.max("score").alias("score"))
    g = per.groupBy("query").agg(F.count_if(F.col("score") >= threshold).alias("n"), F.max_by("player", F.struct("score", -F.col("player"))).alias("player"), F.max("score").alias("score"))
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    return queries.select("query").distinct().join(g, "query", "left").select("query", status.alias("status"), F.when(F.col("n") == 1, F.col("player")).alias("player"), "score")


def resolve(queries: DataFrame, players: DataFrame, aliases: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact matches first; distinct names that have none are compared with all players by similarity."""
    exact = exact_matches(queries, players, aliases)
    rest = queries.join(exact.select("query"), "query", "left_anti")
    fuzzy = similar_names(rest.select(F.col("key").alias("query")).distinct(), players.select("player", "key"), LEAST)
    named = rest.alias("r").join(fuzzy.alias("f"), F.col("r.key") == F.col("f.query")).select("r.query", "f.player", "f.score")
    return verdicts(queries, exact.select("query", "player", "score").unionByName(named), threshold)


def _ranked(candidates: DataFrame, most: int) -> DataFrame:
    """The ``most`` best candidates of each query: by score, then name, then player."""
    w = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("name"), F.asc("player"))
    return candidates.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def _judged(candidates: DataFrame, threshold: float) -> DataFrame:
    """Per query of ``candidates`` (query, player, score, mode): status, and the player and mode of the only one that reaches
    the threshold."""
    high = F.col("score") >= threshold
    one = F.max(F.when(high, F.struct("score", "player", "mode")))
    g = candidates.groupBy("query").agg(F.count_if(high).alias("n"), one.alias("b"))
    alone = lambda c: F.when(F.col("n") == 1, F.col(f"b.{c}")).alias(c)
    return g.select("query", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"), alone("player"), alone("mode"))


def resolve_identities(queries: DataFrame, players: DataFrame, aliases: DataFrame, search: Callable[[DataFrame], DataFrame] | None = None, threshold: float = THRESHOLD, margin: float = MARGIN, most: int = SUGGESTIONS) -> DataFrame:
    """Per query the outcome of the stages exact, fuzzy and embedding: query, status (AUTO_LINKED, UNRESOLVED), player,
    game_id, reason (one of six) and suggestions (player, game_id, name, source), the ``most`` best of all stages.

    ``queries`` (query: distinct, key, shown) are names without alliances, ``players`` (player, game_id, name, key, shown), ``aliases``
    (alias_key, player). Each stage takes what the one before left, as a table: names without an exact match are compared
    with all players, and only names that neither stage resolved go to ``search``, which returns their hits (query, player, similarity,
    fused) among embedded players; hits of unknown players are dropped. A player that two stages propose keeps its better score,
    the earlier stage's on ties. The embedding's verdict comes first, as it is only asked where the others have none.

    Names without letters or digits are ``empty-name`` without suggestions; without ``search`` nothing is embedded; names of equal
    score are in order of code points.
    """
    known = players.select("player", "game_id", "name")
    named = queries.filter("key <> ''")
    by_alias = named.join(aliases, named.key == aliases.alias_key).join(known, "player").select("query", "player", "name", F.lit("exact_alias").alias("mode"))
    lower = known.withColumn("_n", F.lower("name"))
    by_name = named.select("query", F.lower("query").alias("_n")).join(lower, "_n").select("query", "player", "name", F.lit("exact_name").alias("mode"))
    exact = by_alias.unionByName(by_name).groupBy("query", "player", "name").agg(F.min("mode").alias("mode")).withColumn("score", F.lit(1.0))
    exact = written(exact.select("query", "player", "name", "score", "mode"), "exact")

    rest = named.join(exact, "query", "left_anti")
    near = similar_players(rest, players.select("player", "key", "shown"), LEAST).join(known.select("player", "name"), "player")
    fuzzy = written(near.select("query", "player", "name", "score", F.lit("fuzzy").alias("mode")), "fuzzy")

    found = exact.unionByName(fuzzy)
    verdicts = written(_judged(found, threshold), "verdicts")
    ambiguous = verdicts.filter("status = 'ambiguous'").select("query")
    # of ambiguous fuzzy names only those that reach the threshold are candidates
    others = found.join(ambiguous, "query", "left_anti").unionByName(found.filter(F.col("score") >= threshold).join(ambiguous, "query", "left_semi"))
    proposed = _ranked(others, most).withColumn("stage", F.lit(0)).drop("place")

    left = named.join(verdicts.filter("status = 'resolved'"), "query", "left_anti")
    if search is None:
        embedded = queries.sparkSession.createDataFrame([], "query string, status_e string, player_e long, candidates array<struct<player:bigint,name:string,score:double>>")
    else:
        embedded = written(_embedded(search(left), known, threshold, margin, most), "embedded")
    more = embedded.select("query", F.explode("candidates").alias("c")).select("query", "c.player", "c.name", "c.score", F.lit("embedding").alias("mode"), F.lit(1).alias("stage"))
    best = proposed.unionByName(more).groupBy("query", "player").agg(F.max_by(F.struct("name", "score", "mode"), F.struct("score", -F.col("stage"))).alias("b")).select("query", "player", "b.*")
    ids = known.select("player", "game_id")
    source = F.when(F.col("mode") == "exact_alias", "alias").otherwise("name")
    listed = _ranked(best, most).join(ids, "player").select("query", F.struct("place", "player", "game_id", "name", source.alias("source")).alias("s"))
    suggestions = listed.groupBy("query").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s.dropFields("place")).alias("suggestions"))

    out = queries.select("query", "key").join(verdicts, "query", "left").join(embedded.select("query", "status_e", "player_e"), "query", "left").join(suggestions, "query", "left")
    linked = F.coalesce(F.when(F.col("status_e") == "resolved", F.col("player_e")), F.when(F.col("status") == "resolved", F.col("player")))
    reason = (
        F.when(F.col("key") == "", "empty-name").when(F.col("status_e") == "resolved", "embedding-fallback-high-confidence")
        .when((F.col("status") == "resolved") & (F.col("mode") == "exact_alias"), "alias-exact").when((F.col("status") == "resolved") & (F.col("mode") == "exact_name"), "name-exact")
        .when(F.col("status") == "resolved", "name-fuzzy-high-confidence").when((F.col("status") == "ambiguous") | (F.col("status_e") == "ambiguous"), "ambiguous").otherwise("no-unique-match")
    )
    none = F.array().cast(suggestions.schema["suggestions"].dataType)
    out = out.select("query", linked.alias("player"), reason.alias("reason"), F.coalesce("suggestions", none).alias("suggestions")).join(ids, "player", "left")
    return out.select("query", F.when(F.col("player").isNotNull(), "AUTO_LINKED").otherwise("UNRESOLVED").alias("status"), "player", "game_id", "reason", "suggestions")


def _embedded(hits: DataFrame, known: DataFrame, threshold: float, margin: float, most: int) -> DataFrame:
    """Per query with hits of known players: status_e, player_e (if resolved), candidates (the ``most`` best players)."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.greatest(F.col("similarity"), F.col("fused") * 60)))
    best = hits.groupBy("query", "player").agg(F.max_by(score, F.struct("similarity", "fused")).alias("score")).join(known.select("player", "name"), "player")
    rows = _ranked(best, most).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "player", "name", "score"))).alias("c"))
    top = F.col("c")[0]["score"]
    lead = top - F.coalesce(F.try_element_at("c", F.lit(2))["score"], F.lit(0.0))
    status = F.when((top >= threshold) & (lead >= margin), "resolved").when(top >= threshold, "ambiguous").otherwise("unresolved")
    rows = rows.withColumn("status_e", status)
    return rows.select("query", "status_e", F.when(F.col("status_e") == "resolved", F.col("c")[0]["player"]).alias("player_e"), F.transform("c", lambda s: s.dropFields("place")).alias("candidates"))


def alias_candidates(names: DataFrame) -> DataFrame:
    """The aliases of each name (seq, player, name: as shown, tag, tracked): the name, and ``[TAG] name`` where its alliance is a
    tracked one: seq, part, player, alias, alias_key. Aliases without a key, ``unknown`` ones, and a second one of the same key
    are left out; a name that is empty, or whose player is unknown, has one row without a key."""
    from boardlake.functions.vectorized import normalize_alias

    tagged = F.when(F.col("tracked") & (F.coalesce("tag", F.lit("")) != ""), F.concat(F.lit("["), "tag", F.lit("] "), "name"))
    known = (F.coalesce("name", F.lit("")) != "") & F.col("player").isNotNull()
    both = F.when(known, F.array_compact(F.array("name", tagged))).otherwise(F.array(F.lit("")))
    rows = names.select("seq", "player", F.posexplode(both).alias("part", "alias")).withColumn("alias_key", normalize_alias("alias"))
    rows = rows.filter((F.col("alias") == "") | ~F.col("alias_key").isin("", "unknown"))
    return rows.groupBy("seq", "player", "alias_key").agg(F.min_by(F.struct("part", "alias"), "part").alias("a")).select("seq", "a.part", "player", "a.alias", "alias_key")


def seed_aliases(candidates: DataFrame, aliases: DataFrame) -> DataFrame:
    """What becomes of each candidate (alias_key, player, seq, part: of one name, if there is one): seeded, conflict (owned by
    another), skipped (own, or without a key).

    Of several candidates for a free key the first (by seq) seeds it and the others are judged against that: the first of each key
    comes by partial sums, so no key is gathered.
    """
    order = F.struct("seq", "part") if "part" in candidates.columns else F.struct("seq")
    keyed = candidates.filter("alias_key <> ''")
    firsts = keyed.groupBy("alias_key").agg(F.min(order).alias("_at"), F.min_by("player", order).alias("_first"))
    joined = keyed.join(firsts, "alias_key").join(aliases.select("alias_key", F.col("player").alias("owner")), "alias_key", "left")
    own = F.col("owner").isNull() & (order == F.col("_at"))
    outcome = F.when(own, "seeded").when(F.coalesce("owner", "_first") == F.col("player"), "skipped").otherwise("conflict")
    out = joined.select(*candidates.columns, outcome.alias("outcome"))
    return out.unionByName(candidates.filter("alias_key is null or alias_key = ''").withColumn("outcome", F.lit("skipped")))


def alias_outcomes(seeded: DataFrame) -> DataFrame:
    """One row: how many candidates were seeded, in conflict and skipped."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return seeded.agg(n("seeded"), n("conflict"), n("skipped"))


def fallback(hits: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Hits (query, player, similarity, fused) -> status by the best hit of each player and its lead over the next."""
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.greatest(F.col("similarity"), F.col("fused") * 60)))
    best = hits.groupBy("query", "player").agg(F.max_by(F.struct(score.alias("score")), F.struct("similarity", "fused")).alias("b")).select("query", "player", "b.score")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "player")
    top = best.withColumns({"_n": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("_n = 1").drop("_n")
    lead = F.col("score") - F.coalesce("next", F.lit(0.0))
    return top.withColumn("status", F.when((F.col("score") >= threshold) & (lead >= margin), "resolved").when(F.col("score") >= threshold, "ambiguous").otherwise("unresolved"))


def rerun_match(rows: DataFrame, again: DataFrame) -> DataFrame:
    """For each reviewed row the re-extracted one of the same rank, else of the same name, else the run's first."""
    first = lambda keys: again.groupBy("run", *keys).agg(F.min_by("new_id", "pos").alias("m"))
    by_rank = first(["rank"]).filter("rank is not null").withColumnRenamed("m", "m_rank")
    by_name, by_run = first(["name"]).withColumnRenamed("m", "m_name"), first([]).withColumnRenamed("m", "m_first")
    out = rows.join(by_rank, ["run", "rank"], "left").join(by_name, ["run", "name"], "left").join(by_run, "run", "left")
    how = F.when(F.col("m_rank").isNotNull(), "rank").when(F.col("m_name").isNotNull(), "name").when(F.col("m_first").isNotNull(), "first")
    return out.select("run", "id", F.coalesce("m_rank", "m_name", "m_first").alias("new_id"), how.alias("how"))
