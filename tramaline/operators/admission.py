"""Whether a document may be translated: in whole, in part, as a preview, or not, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the free mode in all; formats of which a part may be translated.
FREE_MODE_PAGES, IN_PARTS = 20, ["pdf", "pptx"]


def admission(requests: DataFrame, free_mode_pages: int = FREE_MODE_PAGES, in_parts: list[str] = IN_PARTS) -> DataFrame:
    """requests with decision, reason, pages, preview_pages, from_plan, from_credits, missing and partial_possible.

    Columns read: pages_asked, pages_paid (of an earlier run), free (the plan is), plan_left (pages that the plan still
    offers; null: no bound), credits, verified, resumes, risk (why offered pages are refused, or null), free_mode (the user
    takes a preview for what isn't covered), free_used (its pages so far), format, covered_only (the user asks for the covered
    part). In order:

    * a resumed document of a free, unverified user without credits is refused: verify_email;
    * what plan and credits cover is translated in full; a risk takes away a free plan's pages;
    * in free mode, of a new document, the rest comes as preview, unless the user's preview pages run out: free_mode_limit
      then says so beside the refusal;
    * the covered part alone, if asked for, if the format allows it and nothing was paid before;
    * else refused: free_limit_device if a risk took the plan's pages, or need_credits, with the pages missing.

    Null amounts count as 0, null flags as false.
    """
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    zero = F.lit(0).cast("long")
    needed = F.greatest(n("pages_asked") - n("pages_paid"), zero)
    at_risk = yes("free") & F.col("risk").isNotNull() & (n("plan_left") > 0)
    left = F.when(at_risk, zero).otherwise(F.col("plan_left").cast("long"))
    r = requests.withColumns({"_needed": needed, "_risk": at_risk, "_left": left, "_credits": F.greatest(n("credits"), zero)})
    r = r.withColumn("_covered", F.col("_left") + F.col("_credits")).withColumn("_short", F.coalesce(F.col("_needed") > F.col("_covered"), F.lit(False)))
    unverified = yes("resumes") & (F.col("_needed") > 0) & yes("free") & ~yes("verified") & (F.col("_credits") == 0)
    wants_preview = yes("free_mode") & F.col("_short") & (n("pages_paid") == 0) & ~yes("resumes")
    rest = F.col("_needed") - F.col("_covered")
    over = n("free_used") + rest > free_mode_pages
    partial = F.col("format").isin(in_parts) & (F.col("_covered") > 0) & (n("pages_paid") == 0)
    r = r.withColumn("_partial", F.coalesce(partial, F.lit(False)) & F.col("_short"))
    decision = (
        F.when(unverified, "refused").when(~F.col("_short"), "full").when(wants_preview & ~over, "preview")
        .when(yes("covered_only") & F.col("_partial"), "partial").otherwise("refused")
    )
    r = r.withColumn("decision", decision)
    reason = F.when(unverified, "verify_email").when(F.col("decision") != "refused", F.lit(None)).when(F.col("_risk"), "free_limit_device").when(wants_preview & over, "free_mode_limit").otherwise("need_credits")
    pages = F.when(F.col("decision") == "full", F.col("_needed")).when(F.col("decision") == "refused", zero).otherwise(F.col("_covered"))
    r = r.withColumns({"reason": reason, "pages": pages})
    from_plan = F.least(F.col("pages"), F.coalesce(F.col("_left"), F.col("pages")))
    out = {
        "preview_pages": F.when(F.col("decision") == "preview", rest).otherwise(zero), "from_plan": from_plan, "from_credits": F.col("pages") - from_plan,
        "missing": F.when(F.col("_short"), rest).otherwise(zero), "partial_possible": F.col("_partial"),
    }
    return r.select(*requests.columns, "decision", "reason", "pages", *(c.alias(k) for k, c in out.items()))
