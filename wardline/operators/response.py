"""Choosing a response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.operators.detect import MAX_RULES, category_key, category_lists, own_key
from wardline.operators.sizing import checked_broadcast, measured
from wardline.session import checkpointed


def select_playbook(
    cases: DataFrame, playbook: DataFrame, feedback: DataFrame | None = None, segment: str = "segment", max_plays: int = MAX_RULES
) -> DataFrame:
    """The playbook of highest utility (benefit x risk - cost) whose conditions hold; ties by id, 0 if none holds.

    Playbooks that prove to be few are lists per category next to each case, as in rule matching, and nothing is
    shuffled; more are joined by their category or a wildcard.  Every row of `cases` is decided on its own.

    `feedback`, as `playbook_feedback` gives it, closes the loop: in a case's segment the adjusted benefit of a
    playbook takes the place of its own where there are outcomes.
    """
    plays = playbook.select("category", "playbook_id", "min_risk", F.col("mission").alias("_mission"), "benefit", "cost")
    learned = F.create_map().cast("map<string,double>")
    if feedback is not None:
        by_segment = F.map_from_entries(F.collect_list(F.struct(F.col(segment).cast("string"), F.col("adjusted_benefit").cast("double"))))
        known = feedback.where(F.col(segment).isNotNull()).groupBy("playbook_id").agg(by_segment.alias("_learned"))
        plays = plays.join(known, "playbook_id", "left")
        learned = F.coalesce(F.col("_learned"), learned)
    plays, few = measured(plays.withColumn("_learned", learned), max_plays)

    def worth(play) -> Column:
        """(utility, -id) of a playbook for a case, null if a condition does not hold."""
        fits = (play("min_risk").isNull() | (F.col("risk") >= play("min_risk"))) & (
            play("_mission").isNull() | (play("_mission") == F.col("mission"))
        )
        benefit = play("benefit")
        if feedback is not None:
            benefit = F.coalesce(F.element_at(play("_learned"), F.coalesce(F.col(segment).cast("string"), F.lit(""))), benefit)
        utility = F.round(benefit * F.col("risk") - play("cost"), 6)
        return F.when(fits, F.struct(utility.alias("u"), (-play("playbook_id")).alias("p")))

    if few:
        own, every = category_lists(plays, F.struct("playbook_id", "min_risk", "_mission", "benefit", "cost", "_learned"))
        looked = cases.withColumn("_key", own_key(F.col("category"))).join(own, "_key", "left").withColumn("_every", every)
        found = looked.withColumn("_b", F.array_max(F.transform("_every", lambda r: worth(lambda c: r[c]))))
    else:
        rows = checkpointed(cases.withColumn("_row", F.monotonically_increasing_id()))
        keyed = plays.withColumn("_key", category_key(F.col("category"))).drop("category")
        looked = rows.withColumn("_key", F.explode(F.array(own_key(F.col("category")), category_key(F.lit(None)))))
        best = looked.join(checked_broadcast(keyed), "_key").groupBy("_row").agg(F.max(worth(F.col)).alias("_b"))
        found = rows.join(best, "_row", "left")
    return found.select(
        *cases.columns,
        F.coalesce(-F.col("_b.p"), F.lit(0)).cast("int").alias("playbook_id"),
        F.coalesce(F.col("_b.u"), F.lit(0.0)).alias("utility"),
    )


def playbook_feedback(
    outcomes: DataFrame, playbook: DataFrame, prior: tuple[float, float] = (1.0, 1.0), segment: str = "segment"
) -> DataFrame:
    """Smoothed success rate per playbook and segment, and the playbook's benefit adjusted by it.

    `outcomes`: (playbook_id, segment, success); a null success is not decided yet and does not count.
    """
    a, b = prior
    rates = outcomes.groupBy("playbook_id", segment).agg(
        F.count("success").alias("n"), F.count_if(F.col("success")).alias("n_ok")
    )
    rate = (F.col("n_ok") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return rates.withColumn("rate", rate).join(playbook.select("playbook_id", "benefit"), "playbook_id").select(
        "playbook_id", segment, "n", "n_ok", "rate", (F.col("benefit") * F.col("rate")).alias("adjusted_benefit")
    )
