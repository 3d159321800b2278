"""Questions routed by rule, and contracts of approved plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wordings by the route they ask for, in order of precedence.
ROUTES = (("compare", "비교|차이|각각"), ("select", "모두|목록|어떤 사업|찾아"), ("extract", "예산|기간|기한|배점|제출|마감"))


def route(question: Column) -> Column:
    """First route whose wording a question has, else ``qa``; null stays null."""
    out = F.when(question.isNull(), F.lit(None).cast("string"))
    for name, wording in ROUTES:
        out = out.when(question.rlike(wording), name)
    return out.otherwise("qa")


def plan_problem(plan: str = "approved_plan") -> Column:
    """What keeps a plan from being executed, null if nothing does."""
    p = F.col(plan)
    ids = F.coalesce(F.size(p["document_ids"]), F.lit(0))
    return F.when(p.isNull(), "no plan").when(p["action"].isNull(), "no action").when((p["document_scope"] == "explicit") & (ids <= 0), "no documents")
