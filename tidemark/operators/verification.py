"""Whether published offers still hold: a queue, what was found out about each, and what that changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import blank, strip_tags
from tidemark.operators.extract import loose_json

#: Fewer visible characters than this tell nothing of an offer.
LEAST_TEXT = 40


def verification_queue(offers: DataFrame, most: int | None = 25) -> DataFrame:
    """Active, published offers (id, last_verified_at, ...) in the order in which they are due: never verified first, then the longest ago.

    With `most` the first ones; without, all of them, in no order.
    """
    due = offers.where((F.col("status") == "active") & F.col("review_status").isin("auto_ok", "approved") & F.col("archived_at").isNull())
    order = [F.asc_nulls_first("last_verified_at"), F.asc("id")]
    return due.orderBy(*order).limit(most) if most is not None else due


def prompts(queue: DataFrame, pages: DataFrame, most_text: int = 6000) -> DataFrame:
    """id, prompt: what a model is asked about each offer whose page (id, status, html) was read and shows text."""
    shown = strip_tags(F.col("html"))
    offer = F.concat_ws("｜", "provider", "title", F.nullif(F.col("summary"), F.lit("")), F.nullif(F.col("benefit_text"), F.lit("")))
    seen = queue.join(pages, "id").where(F.col("status_code").between(200, 299)).withColumn("_shown", shown).where(F.length("_shown") >= LEAST_TEXT)
    return seen.select("id", F.concat(F.lit("Offer: "), offer, F.lit("\n\nPage:\n"), F.substring("_shown", 1, most_text), F.lit("\n\nDoes the offer still hold? Answer as JSON: stillValid, reason.")).alias("prompt"))


def outcomes(queue: DataFrame, pages: DataFrame, replies: DataFrame) -> DataFrame:
    """id, outcome, reason of each offer in the queue.

    pages (id, status_code, html): what the offer's link gave, a null code where
    nothing answered. replies (id, reply_code, reply): the model's answer as text.
    A page that is gone ends the offer; one that cannot be read, or shows no text,
    leaves it; otherwise the answer counts. Outcomes are ended, unreachable,
    confirmed, undecided (no clear answer), failed (no answer) and skipped: the
    credentials were refused for this offer or for one that is due before it, and
    nothing was learnt.
    """
    said = loose_json(F.col("reply"), "stillValid boolean, reason string")
    met = queue.select("id", "last_verified_at").join(pages.select("id", "status_code", "html"), "id", "left").join(replies.select("id", "reply_code", "reply"), "id", "left")
    read = met.withColumn("_said", said).withColumn("_due", F.struct(F.coalesce(F.col("last_verified_at").cast("string"), F.lit("")).alias("at"), "id"))
    ok = F.col("status_code").between(200, 299)
    gone = F.coalesce(F.col("status_code").isin(404, 410), F.lit(False))
    silent = ~F.coalesce(ok, F.lit(False)) | (F.length(strip_tags(F.col("html"))) < LEAST_TEXT)
    asked = read.withColumn("_gone", gone).withColumn("_silent", silent & ~gone)
    refused = ~F.col("_gone") & ~F.col("_silent") & F.coalesce(F.col("reply_code").isin(401, 403), F.lit(False))
    first = asked.where(refused).agg(F.min("_due").alias("_stop"))  # one row
    stopped = asked.join(F.broadcast(first)).withColumn("_after", F.coalesce(F.col("_due") >= F.col("_stop"), F.lit(False)))
    outcome = (
        F.when(F.col("_after"), "skipped").when(F.col("_gone"), "ended").when(F.col("_silent"), "unreachable").when(F.col("reply").isNull(), "failed")
        .when(F.col("_said.stillValid"), "confirmed").when(~F.col("_said.stillValid"), "ended").otherwise("undecided")
    )
    reason = F.when(outcome == "ended", F.when(F.col("_gone"), F.concat(F.lit("page "), F.col("status_code").cast("string"))).otherwise(blank(F.col("_said.reason"))))
    return stopped.select("id", outcome.alias("outcome"), reason.alias("reason"))


def verified(table: DataFrame, found: DataFrame, today: Column, as_of: Column) -> DataFrame:
    """The table after a round: ended offers get the override, and a last day if they had none; all that were looked at get the time."""
    f = found.select(F.col("id").alias("_id"), F.col("outcome").alias("_outcome"))
    met = table.join(f, F.col("id") == F.col("_id"), "left")
    ended = F.coalesce(F.col("_outcome") == "ended", F.lit(False))
    looked = F.coalesce(~F.col("_outcome").isin("failed", "skipped"), F.lit(False))
    return met.withColumns({
        "status_override": F.when(ended, "ended").otherwise(F.col("status_override")), "end_date": F.when(ended & F.col("end_date").isNull(), today).otherwise(F.col("end_date")),
        "last_verified_at": F.when(looked, as_of).otherwise(F.col("last_verified_at")),
    }).select(*table.columns)


def tally(found: DataFrame) -> DataFrame:
    """One row: checked, ended, confirmed, unreachable."""
    is_ = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return found.agg(F.count_if(F.col("outcome") != "skipped").alias("checked"), is_("ended").alias("ended"), is_("confirmed").alias("confirmed"), is_("unreachable").alias("unreachable"))
