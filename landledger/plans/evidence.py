"""Evidence on records: what other registers and the ownership history say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landledger.fixed import PENALTY
from landledger.functions.ordered import union_all
from landledger.functions.text import trim
from landledger.operators.chain import (
    chain_findings, chain_replay, chain_status, owner_vs_chain, parcel_history, standing_entries,
)
from landledger.operators.decisions import records_of_parcels
from landledger.operators.findings import FINDINGS, penalty_sum
from landledger.operators.places import place_pairs, with_keys
from landledger.operators.quality import quality_score
from landledger.operators.reconcile import reconcile_sources, reconciliation_findings
from landledger.operators.risk import contradicted_flag, district_risk, parcel_best_copy
from landledger.session import settle, stored


class Evidence:
    """Everything known about parcels beyond the pages, prepared once for many readers."""

    def __init__(self, records: DataFrame, sources: DataFrame, parcels: DataFrame, mutations: DataFrame, now: str):
        self.records, self.sources, self.now = records, sources, now
        self.pairs = place_pairs(with_keys(records), with_keys(sources), with_keys(parcels))
        self.standing = stored(standing_entries(mutations))
        self.replay = stored(chain_replay(self.standing))
        self.register = chain_findings(self.standing, now, self.replay)
        self.status = chain_status(parcels, self.standing, self.register)
        self.history = settle(parcel_history(records, parcels, self.pairs))

    def owner_issues(self) -> DataFrame:
        owners = self.records.select("document_id", "owner_name").join(self.history, "document_id")
        return owner_vs_chain(owners, self.replay)

    def issues(self) -> DataFrame:
        """document_id, origin, copies, issues: one row per source row, register finding or owner check."""
        register = self.register.selectExpr(
            "parcel_id",
            "cast(array(named_struct('field', 'owner_name', 'kind', if(severity = 'critical', 'chainDefect', 'chainWarning'), "
            f"'code', code, 'params', params, 'issue', issue)) as {FINDINGS}) as issues",
        )
        return union_all([
            reconciliation_findings(self.records, self.sources, self.now, self.pairs)
            .selectExpr("document_id", "'sources' as origin", "copies", "issues"),
            self.history.join(register, "parcel_id").selectExpr("document_id", "'chain' as origin", "1L as copies", "issues"),
            self.owner_issues().selectExpr("document_id", "'owner' as origin", "1L as copies", "issues"),
        ])

    def weights(self) -> DataFrame:
        """Per record: points lost to evidence, and whether it contradicts the record."""
        by_source = source_weights(self.records, self.sources, self.now, self.pairs)
        return summed([by_source, chain_weights(self.history, self.register), owner_weights(self.owner_issues())])


def source_weights(records: DataFrame, sources: DataFrame, now: str, pairs: DataFrame) -> DataFrame:
    return reconciliation_findings(records, sources, now, pairs).selectExpr(
        "document_id", f"copies * {penalty_sum()} as points", f"{contradicted_flag()} as against", "false as critical"
    )


def chain_weights(history: DataFrame, register: DataFrame) -> DataFrame:
    """Register findings are summed per parcel first, so a parcel with many copies and many findings never multiplies out."""
    per_parcel = register.groupBy("parcel_id").agg(
        F.expr(f"sum(if(severity = 'critical', {PENALTY['chainDefect']}L, {PENALTY['chainWarning']}L)) as points"),
        F.expr("bool_or(severity = 'critical') as critical"),
    )
    return history.join(per_parcel, "parcel_id").selectExpr("document_id", "points", "critical as against", "critical")


def owner_weights(owner_issues: DataFrame) -> DataFrame:
    return owner_issues.selectExpr(
        "document_id", f"{penalty_sum()} as points", f"{contradicted_flag()} as against",
        "exists(issues, i -> i.kind = 'chainDefect') as critical",
    )


def summed(weights: list[DataFrame]) -> DataFrame:
    return union_all(weights).groupBy("document_id").agg(
        F.sum("points").alias("evidence_points"), F.expr("bool_or(against) as against"),
        F.expr("bool_or(critical) as critical_chain"),
    )


def evidence_findings(
    records: DataFrame, sources: DataFrame, parcels: DataFrame, mutations: DataFrame, now: str
) -> DataFrame:
    return Evidence(records, sources, parcels, mutations, now).issues()


def score_with_evidence(validated: DataFrame, evidence: Evidence) -> DataFrame:
    """Validated records scored on their own findings plus the live evidence."""
    return quality_score(
        validated.join(evidence.weights(), "document_id", "left"), "evidence_points"
    )


def score_districts(
    validated: DataFrame, sources: DataFrame, parcels: DataFrame, mutations: DataFrame, now: str,
    district: str | None = None,
) -> DataFrame:
    """District risk over validated records: best copy per parcel, scored with live evidence."""
    wanted = validated.filter("district is not null and status <> 'REJECTED'")
    if district is not None:
        wanted = wanted.filter(F.col("district") == district)
    best = stored(parcel_best_copy(wanted))
    evidence = Evidence(best, sources, parcels, mutations, now)
    reconciled = reconcile_sources(best, sources, now, evidence.pairs).selectExpr(
        "document_id", "size(matched) as matched_count", "reconciliation"
    )
    chains = evidence.history.join(evidence.status.select("parcel_id", "chain_status"), "parcel_id").drop("parcel_id")
    # A traced chain is also in defect when only the owner check found something.
    scored = (
        score_with_evidence(best, evidence)
        .join(reconciled, "document_id").join(chains, "document_id", "left")
        .join(evidence.owner_issues().selectExpr("document_id", "true as owner_differs"), "document_id", "left")
        .selectExpr(
            "district", "quality_score", "band", "reconciliation", "matched_count",
            "case when coalesce(chain_status, 'EMPTY') = 'CLEAN' and owner_differs then 'DEFECTS' "
            "else coalesce(chain_status, 'EMPTY') end as chain_status",
            "int(coalesce(critical_chain, false)) as critical",
            f"coalesce({contradicted_flag()}, false) or coalesce(against, false) as contradicted",
        )
    )
    return district_risk(scored)


def rescore_parcels(
    validated: DataFrame, sources: DataFrame, parcels: DataFrame, mutations: DataFrame,
    orders: DataFrame, decided: DataFrame, now: str,
) -> DataFrame:
    """Records of the parcels whose registers decided orders have changed, scored before and after.

    ``validated`` has the findings stored with the records, ``orders`` the place of every order,
    ``decided`` the outcomes (:func:`order_decisions`). Columns: document_id, score_before,
    score_after, band (after) and moved. Only records that describe a changed parcel are
    looked at, and only their registers are replayed: as they were, and with the new entries. What
    other sources say is the same before and after, and is worked out once.
    """
    columns = ["parcel_id", "id", "seq", "type", "from_owner", "to_owner", "share", "mutation_number", "effective_date", "supersedes_id"]
    entered, parcels = stored(decided.filter("outcome = 'ENTERED'")), stored(parcels)
    places = stored(
        entered.select("document_id", "parcel_id").join(orders.select("document_id", "khasra_number", "village", "district"), "document_id")
    )
    touched = stored(records_of_parcels(validated, places))
    # Orders may have opened registers; these are known by the place of their first order.
    opened = places.join(parcels.select("parcel_id"), "parcel_id", "left_anti").groupBy("parcel_id").agg(
        *[F.expr(f"min_by({trim(c)}, document_id) as {c}") for c in ("khasra_number", "village", "district")]
    )
    known = {False: parcels.select(*opened.columns)}
    known[True] = known[False].unionByName(opened)
    # No entry has a negative id, so those of orders come last among equals.
    entries = entered.withColumns({"id": -F.col("document_id") - 1, "supersedes_id": F.lit(None).cast("long")}).select(*columns)
    pairs = settle(place_pairs(with_keys(touched), with_keys(sources), with_keys(known[True])))
    by_source = settle(source_weights(touched, sources, now, pairs))
    owners = touched.select("document_id", "owner_name")
    scores, mutations = {}, stored(mutations.select(*columns))
    for after, register in ((False, mutations), (True, mutations.unionByName(entries))):
        history = settle(parcel_history(touched, known[after], pairs))
        standing = stored(standing_entries(register.join(history.select("parcel_id").distinct(), "parcel_id", "left_semi")))
        replay = stored(chain_replay(standing))
        weights = summed([
            by_source, chain_weights(history, chain_findings(standing, now, replay)),
            owner_weights(owner_vs_chain(owners.join(history, "document_id"), replay)),
        ])
        scored = quality_score(touched.join(weights, "document_id", "left"), "evidence_points")
        scores[after] = scored.select("document_id", "quality_score", "band")
    before = scores[False].select("document_id", F.col("quality_score").alias("score_before"))
    return before.join(scores[True].withColumnRenamed("quality_score", "score_after"), "document_id").withColumn(
        "moved", F.col("score_before") != F.col("score_after")
    )
