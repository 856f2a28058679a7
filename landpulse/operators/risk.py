"""Risk serving: latest states, scoring, bands, actions, what-if and dashboard answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from landpulse.functions.literals import literal_table
from landpulse.functions.numeric import clip, platt, ratio_or_zero, round_half_even
from landpulse.functions.text import feature_category, feature_label
from landpulse.operators import skew
from landpulse.operators.quality import row_count
from landpulse.operators.timeline import STAGES

# Band limits, trend step, horizons, action rules, defaults and page sizes.
BANDS = ["LOW", "MODERATE", "HIGH", "CRITICAL"]
BAND_LIMITS = {"LOW": 0.20, "MODERATE": 0.40, "HIGH": 0.70}
TREND_STEP = 0.20
HORIZONS = ["30d", "60d", "90d"]
HEADLINE = "90d"
ALERT_BANDS = ["HIGH", "CRITICAL"]
UNKNOWN = "Unknown"
RECENT_LIMIT, PRIORITY_LIMIT, AGING_LIMIT, STATE_QUEUE_LIMIT, PAGE_SIZE = 12, 25, 25, 20, 20
AGING_DAYS = 120
MASTER_COLUMNS = ["project_id", "project_name", "project_type", "implementing_agency", "state", "district", "date_initiation"]
SEARCH_COLUMNS = ["project_id", "project_name", "district", "implementing_agency"]
REGISTER_SEARCH_COLUMNS = ["project_id", "project_name", "state", "district", "implementing_agency"]
EDITABLE_FIELDS = {
    "pending_approvals_count": (0, 100),
    "file_pending_days": (0, 3650),
    "docs_complete_pct": (0, 100),
    "disbursal_pct": (0, 100),
    "rnr_progress_pct": (0, 100),
    "grievances_30d": (0, 10000),
    "grievance_redressal_days": (0, 3650),
}
EVIDENCE_LIMIT = 5
PRIORITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}


# --- records -------------------------------------------------------------------------------------------------


def enrich(snapshots: DataFrame, master: DataFrame, one_per_project: bool = False) -> DataFrame:
    """Snapshots with their project's identity and geography; one master row per project is used.

    A history may hold very many snapshots of one project; the latest states (``one_per_project``) cannot.
    """
    facts = master.select(*MASTER_COLUMNS).dropDuplicates(["project_id"])
    if one_per_project:
        return snapshots.join(facts, "project_id", "left")
    return skew.lookup(snapshots, facts, ["project_id"])


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """R2: newest snapshot per project; the rank-1 filter also runs before the shuffle, so long histories shrink first."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("snapshot_date"), F.desc("snapshot_id"))
    return snapshots.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n")


def _folded(column: str) -> Column:
    return F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))


def filter_projects(latest: DataFrame, search: str | None = None, state: str | None = None, stage: str | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """R3 filters: case-insensitive search in any column, exact state and stage, all combined with AND."""
    if search and search.strip():
        needle = search.strip().lower()
        hit = F.lit(False)
        for column in columns or SEARCH_COLUMNS:
            hit = hit | _folded(column).contains(needle)
        latest = latest.filter(hit)
    if state:
        latest = latest.filter(_folded("state") == state.lower())
    if stage:
        latest = latest.filter(_folded("current_stage") == stage.lower())
    return latest


def list_projects(latest: DataFrame, limit: int = 100, offset: int = 0, **filters: str | None) -> DataFrame:
    """One page of projects in id order."""
    return filter_projects(latest, **filters).orderBy("project_id").offset(offset).limit(limit)


def count_projects(latest: DataFrame, **filters: str | None) -> DataFrame:
    """Size of the filtered list."""
    return filter_projects(latest, **filters).agg(row_count().alias("project_count"))


def project_history(snapshots: DataFrame, master: DataFrame, project_id: str) -> DataFrame:
    """All snapshots of one project, oldest first; both tables are filtered by id before they meet."""
    own = snapshots.filter(F.col("project_id") == project_id)
    facts = master.filter(F.col("project_id") == project_id).select(*MASTER_COLUMNS).limit(1)
    return own.join(F.broadcast(facts), "project_id", "left").orderBy("snapshot_date", "snapshot_id")  # one fact row


def project_record(snapshots: DataFrame, master: DataFrame, project_id: str) -> DataFrame:
    """The latest record of one project."""
    return project_history(snapshots, master, project_id).orderBy(F.desc("snapshot_date"), F.desc("snapshot_id")).limit(1)


# --- scoring -------------------------------------------------------------------------------------------------


def derive_missing(records: DataFrame) -> DataFrame:
    """Engineered fields where the record does not bring them; a zero denominator gives 0."""
    number = lambda c: F.col(c).cast("double")
    ratio = lambda a, b: F.when(number(b) > 0, ratio_or_zero(number(a), number(b))).otherwise(F.lit(0.0))
    formulas = {
        "land_acquisition_ratio": (["land_to_acquire_ha", "land_required_ha"], lambda a, b: ratio(a, b)),
        "affected_family_per_parcel": (["affected_families", "total_parcels"], lambda a, b: ratio(a, b)),
        "vulnerable_family_share": (["vulnerable_families", "affected_families"], lambda a, b: ratio(a, b)),
        "compensation_pending_cr": (["compensation_awarded_cr", "compensation_disbursed_cr"],
                                    lambda a, b: clip(number(a) - number(b), 0.0)),
        "rnr_remaining_pct": (["rnr_progress_pct"], lambda a: clip(100.0 - number(a), 0.0)),
        "docs_remaining_pct": (["docs_complete_pct"], lambda a: clip(100.0 - number(a), 0.0)),
    }
    added = {}
    for name, (inputs, formula) in formulas.items():
        if all(c in records.columns for c in inputs):
            computed = formula(*inputs)
            added[name] = F.coalesce(F.col(name), computed) if name in records.columns else computed
    return records.withColumns(added)


def score_horizons(records: DataFrame, raw: dict[str, Column], calibrators: dict[str, tuple[float, float]]) -> DataFrame:
    """Raw and calibrated probability per horizon, as columns of one projection over all records."""
    return records.withColumns({f"raw_{h}": raw[h] for h in raw}).withColumns({
        f"probability_{h}": platt(F.col(f"raw_{h}"), *calibrators[h]) for h in raw
    })


def risk_band(probability: Column) -> Column:
    """Band of a probability; values outside [0, 1] fall into the outer bands, as if clamped."""
    band = F.when(probability.isNull(), F.lit(None).cast("string"))
    for name, limit in BAND_LIMITS.items():
        band = band.when(probability < limit, F.lit(name))
    return band.otherwise(F.lit(BANDS[-1]))


def risk_score(probability: Column) -> Column:
    return round_half_even(clip(probability, 0.0, 1.0) * 100).cast("int")


def risk_percentage(probability: Column) -> Column:
    return round_half_even(probability * 100, 1)


def risk_trend(probabilities: list[Column]) -> Column:
    """Change from the first to the last horizon that is present."""
    delta = F.coalesce(*reversed(probabilities)) - F.coalesce(*probabilities)
    present = sum((p.isNotNull().cast("int") for p in probabilities), F.lit(0))
    return F.when(present < 2, "UNKNOWN").when(delta >= TREND_STEP, "RISING").when(delta <= -TREND_STEP, "FALLING").otherwise("STABLE")


def risk_summary(scored: DataFrame) -> DataFrame:
    """Band, score and percentage per horizon, headline (90 days, else the first present) and trend."""
    p = {h: F.col(f"probability_{h}") for h in HORIZONS}
    headline = F.coalesce(p[HEADLINE], *[p[h] for h in HORIZONS if h != HEADLINE])
    return scored.withColumns({
        **{f"risk_{h}": risk_percentage(p[h]) for h in HORIZONS}, **{f"band_{h}": risk_band(p[h]) for h in HORIZONS},
        **{f"score_{h}": risk_score(p[h]) for h in HORIZONS},
        "risk_band": risk_band(headline), "risk_score": risk_score(headline), "risk_percentage": risk_percentage(headline),
        "trend": risk_trend(list(p.values())),
    })


def risk_document(scored: DataFrame) -> DataFrame:
    """The nested answer for one project: headline plus a map from horizon to its numbers."""
    horizon = lambda h: F.struct(
        F.col(f"probability_{h}").alias("probability"), F.col(f"risk_{h}").alias("percentage"), F.col(f"score_{h}").alias("score"),
        F.col(f"band_{h}").alias("band"),
    )
    horizons = F.create_map(*[v for h in HORIZONS for v in (F.lit(h), horizon(h))])
    return scored.select("project_id", "snapshot_id", F.struct(
        F.col("risk_band").alias("headline_band"), F.col("risk_score").alias("headline_score"),
        F.col("risk_percentage").alias("headline_percentage"), "trend", horizons.alias("horizons"),
    ).alias("risk"))


def project_evidence(drivers: DataFrame, snapshots: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """Risk-increasing 90-day drivers of each snapshot, in words; snapshots without any get one empty row."""
    own = drivers.filter((F.col("target") == "delay_next_90d") & (F.col("direction") == "risk_increasing") & (F.col("driver_rank") <= limit))
    label = feature_label(F.col("feature"))
    told = own.select(
        "snapshot_id", "driver_rank", "feature", label.alias("label"), feature_category(F.col("feature")).alias("category"),
        F.col("feature_value").alias("value"), round_half_even(F.col("contribution"), 4).alias("contribution"),
        F.concat(label, F.lit(" is contributing to the model's current risk score.")).alias("explanation"),
    )
    return snapshots.select("project_id", "snapshot_id").join(told, "snapshot_id", "left").withColumn(
        "available", F.col("feature").isNotNull().cast("int")
    )


def model_evidence(drivers: DataFrame, records: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """R12 from a fitted model: the strongest 90-day drivers each way of each record, with the record's own value.

    ``drivers`` carry ``source`` and ``raw_value``: behind a one-hot slot stands the category that the record has.
    Records without any driver get one empty row.
    """
    own = drivers.filter((F.col("target") == "delay_next_90d") & (F.col("driver_rank") <= limit))
    label, up = feature_label(F.col("feature")), F.col("direction") == "risk_increasing"
    told = own.select(
        "snapshot_id", "direction", "driver_rank", "feature", "source", label.alias("label"), feature_category(F.col("feature")).alias("category"),
        F.col("raw_value").alias("value"), round_half_even(F.col("contribution"), 4).alias("contribution"),
        F.concat(label, F.when(up, " is contributing to the model's current risk score.").otherwise(" is reducing the model's current risk score.")).alias("explanation"),
    )
    return records.select("project_id", "snapshot_id").join(told, "snapshot_id", "left").withColumn("available", F.col("feature").isNotNull().cast("int"))


def model_context(importance: DataFrame, limit: int = EVIDENCE_LIMIT) -> DataFrame:
    """The most important features of the 90-day model."""
    top = importance.filter((F.col("target") == "delay_next_90d") & (F.col("rank") <= limit))
    return top.select("rank", "feature", feature_label(F.col("feature")).alias("label"),
                      feature_category(F.col("feature")).alias("category"),
                      round_half_even(F.col("normalized_importance_pct"), 2).alias("normalized_importance_pct"))


def _number_text(value: Column) -> Column:
    """Six significant digits without trailing zeros."""
    digits = F.regexp_replace(F.format_string("%.6g", value), r"(\.\d*?)0+(?=$|e)", "$1")
    return F.regexp_replace(digits, r"\.(?=$|e)", "")


def _action(condition: Column, priority: Column, action: str, category: str, owner: str, trigger: Column, reason: str) -> Column:
    ranks = F.create_map(*[F.lit(v) for pair in PRIORITY_ORDER.items() for v in pair])
    return F.when(condition, F.struct(
        ranks[priority].alias("priority_order"), F.lit(category).alias("category"), F.lit(action).alias("action"),
        F.lit(owner).alias("owner"), priority.alias("priority"), trigger.alias("trigger"), F.lit(reason).alias("reason"),
    ))


def recommended_actions(snapshots: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Eight threshold rules per snapshot, most urgent first; routine monitoring when none fires.

    Missing values take a harmless default; a true zero is a value and can fire a rule.
    """
    def value(field: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(field).cast("double"), F.lit(default))

    approvals, file_days = value("pending_approvals_count"), value("file_pending_days")
    docs, disbursal, rnr = value("docs_complete_pct", 100.0), value("disbursal_pct", 100.0), value("rnr_progress_pct", 100.0)
    awarded, cases = value("compensation_awarded_cr"), value("court_cases_count")
    grievances, redressal, stage_days = value("grievances_30d"), value("grievance_redressal_days"), value("days_in_current_stage")
    high, medium, low = F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")
    urgent = lambda condition: F.when(condition, high).otherwise(medium)
    shown = lambda name, v, unit="": F.concat(F.lit(f"{name} = "), _number_text(v), F.lit(unit))
    # Rule texts, owners and thresholds.
    rules = [
        _action(approvals >= 4, high, "Review pending approvals and assign a responsible department.", "Administrative",
                "Project Authority", shown("pending_approvals_count", approvals),
                "Multiple approvals remain pending in the latest project snapshot."),
        _action(file_days >= 60, high, "Escalate the long-pending administrative file.", "Administrative", "Project Authority",
                shown("file_pending_days", file_days),
                "The administrative file has remained pending for an extended observed period."),
        _action(docs < 80, urgent(docs < 60), "Complete missing acquisition documentation.", "Administrative", "Project Authority",
                shown("docs_complete_pct", docs, "%"),
                "Documentation completeness is below the prototype monitoring threshold."),
        _action((awarded > 0) & (disbursal < 70), urgent(disbursal < 40), "Prioritize compensation disbursement for eligible cases.",
                "Compensation", "Compensation Cell", shown("disbursal_pct", disbursal, "%"),
                "A material share of awarded compensation remains undisbursed."),
        _action(cases >= 2, urgent(cases >= 5), "Review pending legal/title disputes with the legal cell.", "Legal", "Legal Cell",
                shown("court_cases_count", cases), "Open legal disputes are recorded in the latest project snapshot."),
        _action(rnr < 60, urgent(rnr < 35), "Prioritize rehabilitation and resettlement actions.", "Rehabilitation & Resettlement",
                "R&R Cell", shown("rnr_progress_pct", rnr, "%"),
                "R&R implementation progress is below the prototype monitoring threshold."),
        _action((grievances >= 5) | (redressal >= 30), urgent((grievances >= 10) | (redressal >= 60)),
                "Review unresolved grievances and strengthen grievance redressal.", "Community / Grievance",
                "Grievance Redressal Cell",
                F.concat(shown("grievances_30d", grievances, "; "), shown("grievance_redressal_days", redressal)),
                "The latest snapshot indicates elevated grievance volume or extended resolution time."),
        _action(stage_days >= 180, medium, "Conduct a stage-review meeting and record the next transition dependency.",
                "Administrative", "Project Authority", shown("days_in_current_stage", stage_days),
                "The project has an extended observed duration in its current stage."),
    ]
    routine = _action(F.lit(True), low, "Maintain routine milestone monitoring and update the project record.", "Administrative",
                      "Project Authority", F.lit("No rule threshold exceeded"),
                      "No current deterministic escalation threshold was triggered by the latest snapshot.")
    fired = F.sort_array(F.filter(F.array(*rules, routine), lambda r: r.isNotNull()))
    keep = keep or ["project_id", "snapshot_id"]
    ranked = snapshots.select(*keep, F.posexplode(fired).alias("at", "a"))
    # The routine action is the only LOW one and sorts last: it stays only where it stands alone.
    return ranked.filter((F.col("at") == 0) | (F.col("a.priority") != "LOW")).select(
        *keep, (F.col("at") + 1).alias("action_rank"), "a.action", "a.category", "a.owner", "a.priority", "a.trigger", "a.reason",
        F.lit("Open").alias("status"),
    )


def valid_scenarios(scenarios: DataFrame) -> DataFrame:
    """R15 input contract: only editable fields, each null or inside its range, at least one given."""
    extra = [c for c in scenarios.columns if c not in EDITABLE_FIELDS and c != "project_id"]
    if extra:
        raise ValueError(f"not editable: {', '.join(extra)}")
    given = [c for c in EDITABLE_FIELDS if c in scenarios.columns]
    inside = F.lit(True)
    for c in given:
        inside = inside & (F.col(c).isNull() | F.col(c).between(*EDITABLE_FIELDS[c]))
    return scenarios.filter(inside & F.coalesce(*[F.col(c).cast("double") for c in given]).isNotNull())


def what_if(latest: DataFrame, scenarios: DataFrame, scorer, keep: list[str] | None = None) -> DataFrame:
    """Score each scenario's project as it is and with the overrides; change in percentage points and bands.

    ``scorer`` maps records to records with ``probability_<horizon>`` columns.
    """
    keep = keep or ["project_id", "snapshot_id"]
    asked = valid_scenarios(scenarios)
    fields = [c for c in asked.columns if c != "project_id"]
    both = latest.join(asked.withColumnsRenamed({c: f"__{c}" for c in fields}), "project_id")
    summary = lambda df, tag: risk_summary(scorer(df)).select(
        *[F.col(c) for c in df.columns], *[F.col(c).alias(f"{tag}_{c}") for h in HORIZONS for c in (f"risk_{h}", f"band_{h}")]
    )
    before = summary(both, "before")
    changed = before.withColumns({c: F.coalesce(F.col(f"__{c}").cast(latest.schema[c].dataType), F.col(c)) for c in fields})
    after = summary(changed, "after")
    horizon = lambda h: F.struct(
        F.lit(h).alias("horizon"), F.col(f"before_risk_{h}").alias("current_percentage"),
        F.col(f"after_risk_{h}").alias("simulated_percentage"),
        round_half_even(F.col(f"after_risk_{h}") - F.col(f"before_risk_{h}"), 1).alias("estimated_change_percentage_points"),
        F.col(f"before_band_{h}").alias("risk_band_before"), F.col(f"after_band_{h}").alias("risk_band_after"),
    )
    return after.select(*keep, F.inline(F.array(*[horizon(h) for h in HORIZONS])))


# --- dashboard -----------------------------------------------------------------------------------------------


def public_projects(scored: DataFrame) -> DataFrame:
    """The public columns, with 'Unknown' for missing text."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN)).alias(c)
    return scored.select(
        F.col("project_id").cast("string").alias("project_id"), "project_name",
        *[text(c) for c in ("state", "district", "implementing_agency", "project_type", "current_stage")],
        F.coalesce(F.col("days_in_current_stage").cast("int"), F.lit(0)).alias("days_in_current_stage"),
        F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"),
        "risk_band", "risk_percentage", "risk_30d", "risk_60d", "risk_90d", "trend",
    )


def _state() -> Column:
    return F.coalesce(F.nullif(F.col("state"), F.lit("")), F.lit(UNKNOWN)).alias("state")


def _band_counts(prefix: str = "") -> list[Column]:
    return [F.count_if(F.col("risk_band") == b).alias(f"{prefix}{b.lower()}") for b in BANDS]


VIEWS = {"all": [], "state": ["state"], "stage": ["stage"], "agency": ["agency"]}


def dashboard(scored: DataFrame, views: list[str] | None = None) -> DataFrame:
    """One row per national total, state, stage and agency, from one pass over the scored rows.

    ``view`` names the kind of row. Store the result once and let the answers below read it. Without scored rows there is
    no row at all, whereas ``national_kpis`` has its zeros.
    """
    ongoing = F.coalesce(F.col("current_stage"), F.lit("")) != ""
    known = F.coalesce(F.col("raw_state"), F.lit("")) != ""
    agency = F.coalesce(F.nullif(F.col("implementing_agency"), F.lit("")), F.lit(UNKNOWN)).alias("agency")
    named = scored.select(_state(), F.col("current_stage").alias("stage"), agency, "current_stage", "risk_band", "risk_90d", "snapshot_date", F.col("state").alias("raw_state"))
    kept = [v for v in VIEWS if views is None or v in views]
    keys = [k for v in kept for k in VIEWS[v]]
    band = lambda b: F.col("risk_band") == b
    cells = [
        row_count().alias("projects"), F.count_if(ongoing).alias("ongoing_projects"), *_band_counts(),
        *[F.count_if(ongoing & band(b)).alias(f"ongoing_{b.lower()}") for b in ALERT_BANDS],
        F.sum("risk_90d").alias("risk"), F.count("risk_90d").alias("rated"),
        F.sum(F.when(ongoing, F.col("risk_90d"))).alias("ongoing_risk"), F.count(F.when(ongoing, F.col("risk_90d"))).alias("ongoing_rated"),
        F.count_if(known).alias("known"), *[F.count_if(known & (F.col("current_stage") == c)).alias(f"stage_{t}") for c, t in STAGES.items()],
        F.max(F.date_format("snapshot_date", "yyyy-MM-dd")).alias("last_updated"),
    ]
    if not keys:
        return named.agg(*cells).withColumn("view", F.lit("all"))
    view = F.lit("all")
    for key in keys:
        view = F.when(F.grouping(key) == 0, F.lit(key)).otherwise(view)
    return named.groupingSets([[F.col(k) for k in VIEWS[v]] for v in kept], *keys).agg(*cells, view.alias("view"))


def _view(table: DataFrame, name: str) -> DataFrame:
    return table.filter(F.col("view") == name)


def kpis_of(table: DataFrame) -> DataFrame:
    return _view(table, "all").select(F.col("projects").alias("total_projects"), "ongoing_projects", *[b.lower() for b in BANDS], "last_updated")


def states_of(table: DataFrame) -> DataFrame:
    mean = round_half_even(F.try_divide(F.col("ongoing_risk"), F.col("ongoing_rated")), 1)
    return _view(table, "state").filter("ongoing_projects > 0").select(
        "state", "ongoing_projects", F.col("ongoing_high").alias("high_risk_projects"), F.col("ongoing_critical").alias("critical_projects"),
        mean.alias("average_90d_risk")).orderBy(F.desc("ongoing_projects"), "state")


def stages_of(table: DataFrame) -> DataFrame:
    counts = _view(table, "stage").filter("ongoing_projects > 0").select("stage", F.col("ongoing_projects").alias("projects"))
    return _stages(table).join(counts, "stage", "left").fillna(0, subset=["projects"])


def agencies_of(table: DataFrame) -> DataFrame:
    return _view(table, "agency").filter("ongoing_projects > 0").select("agency", "ongoing_projects").orderBy(F.desc("ongoing_projects"), "agency")


def distribution_of(table: DataFrame) -> DataFrame:
    long = _view(table, "all").select(F.col("projects").alias("__all"), *[F.col(b.lower()).alias(b) for b in BANDS]).unpivot(["__all"], BANDS, "risk_band", "projects")
    return long.select("risk_band", "projects", F.coalesce(F.try_divide(F.col("projects"), F.col("__all")) * 100, F.lit(0.0)).alias("share_pct"))


def state_matrix_of(table: DataFrame) -> DataFrame:
    return _view(table, "state").select(
        "state", "projects", *[b.lower() for b in BANDS], round_half_even(F.try_divide(F.col("risk"), F.col("rated")), 1).alias("average_90d_risk")
    ).orderBy(F.desc("critical"), F.desc("high"), F.desc("average_90d_risk"), "state")


def stage_risk_of(table: DataFrame) -> DataFrame:
    mean = F.coalesce(F.col("risk"), F.lit(0.0)) / F.col("projects")  # a project without a risk counts as zero
    grouped = _view(table, "stage").select("stage", "projects", mean.alias("average_90d_risk"))
    return _stages(table).join(grouped, "stage", "left").fillna(0, subset=["projects"]).fillna(0.0, subset=["average_90d_risk"])


def state_stages_of(table: DataFrame) -> DataFrame:
    return _view(table, "state").filter("known > 0").select("state", F.col("known").alias("total"), *[f"stage_{t}" for t in STAGES.values()])


def national_kpis(scored: DataFrame) -> DataFrame:
    """Totals, projects per band (zero where none) and the newest snapshot date."""
    return kpis_of(dashboard(scored, ["all"]))


def projects_by_state(scored: DataFrame) -> DataFrame:
    """Ongoing projects, alerts and mean 90-day risk per state, largest first."""
    return states_of(dashboard(scored, ["state"]))


def _stages(df: DataFrame) -> DataFrame:
    return literal_table(df.sparkSession, [(s,) for s in STAGES], "stage string")


def projects_by_stage(scored: DataFrame) -> DataFrame:
    """Ongoing projects per statutory stage, zero where none."""
    return stages_of(dashboard(scored, ["stage"]))


def projects_by_agency(scored: DataFrame) -> DataFrame:
    """Ongoing projects per agency, largest first."""
    return agencies_of(dashboard(scored, ["agency"]))


def _alerts(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("risk_band").isin(*ALERT_BANDS))


def recently_flagged(scored: DataFrame, limit: int = RECENT_LIMIT) -> DataFrame:
    """Newest alerts, riskiest first within a day."""
    return public_projects(_alerts(scored)).orderBy(F.desc("snapshot_date"), F.desc("risk_percentage"), "project_id").limit(limit)


def risk_distribution(scored: DataFrame) -> DataFrame:
    """Projects and share per band, zero where none; one pass and no grouping key."""
    return distribution_of(dashboard(scored, ["all"]))


def state_risk_matrix(scored: DataFrame) -> DataFrame:
    """Bands and mean 90-day risk per state, most critical first."""
    return state_matrix_of(dashboard(scored, ["state"]))


def priority_queue(scored: DataFrame, limit: int = PRIORITY_LIMIT) -> DataFrame:
    """Riskiest alerts."""
    return public_projects(_alerts(scored)).orderBy(F.desc("risk_percentage"), "project_id").limit(limit)


def register_view(latest: DataFrame, risks: DataFrame, page: int = 1, search: str | None = None, state: str | None = None,
                  stage: str | None = None, band: str | None = None, page_size: int = PAGE_SIZE) -> DataFrame:
    """Projects with risk, searched and filtered, riskiest first, one page."""
    joined = latest.join(risks.select("project_id", "risk_band", "risk_30d", "risk_60d", "risk_90d", "trend"), "project_id", "left")
    if search and search.strip():
        text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in REGISTER_SEARCH_COLUMNS]))
        joined = joined.filter(text.contains(search.strip().lower()))
    for column, wanted in (("state", state), ("current_stage", stage), ("risk_band", band)):
        if wanted:
            joined = joined.filter(F.col(column) == wanted)
    ordered = joined.orderBy(F.desc(F.coalesce("risk_90d", F.lit(0.0))), "project_id")
    return ordered.offset((page - 1) * page_size).limit(page_size)


def stage_risk(scored: DataFrame) -> DataFrame:
    """Projects and mean 90-day risk per stage, zero where none."""
    return stage_risk_of(dashboard(scored, ["stage"]))


def aging_queue(scored: DataFrame, limit: int = AGING_LIMIT) -> DataFrame:
    """Projects 120 days or longer in their stage, longest first."""
    return scored.filter(F.col("days_in_current_stage") >= AGING_DAYS).select(
        "project_id", "project_name", "state", "current_stage", "days_in_current_stage", "risk_90d", "risk_band"
    ).orderBy(F.desc("days_in_current_stage"), "project_id").limit(limit)


def state_stage_matrix(scored: DataFrame) -> DataFrame:
    """Projects per state and stage; projects without a state are left out."""
    return state_stages_of(dashboard(scored, ["state"]))


def state_density(by_state: DataFrame) -> DataFrame:
    """Map class of each state row."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(0))
    density = (
        F.when(filled("critical_projects") > 0, "critical").when(filled("high_risk_projects") > 0, "high")
        .when(filled("average_90d_risk") >= 1, "moderate").otherwise("low")
    )
    return by_state.withColumn("density_class", density)


def state_queues(scored: DataFrame, limit: int = STATE_QUEUE_LIMIT) -> DataFrame:
    """Riskiest projects of every state; the rank filter also runs before the shuffle."""
    ranked = Window.partitionBy("state").orderBy(F.desc(F.coalesce("risk_90d", F.lit(0.0))), "project_id")
    return scored.withColumn("queue_rank", F.row_number().over(ranked)).filter(F.col("queue_rank") <= limit).select(
        "state", "queue_rank", "project_id", "project_name", "district", "current_stage", "risk_90d", "risk_band"
    )


def merged_state_rows(overview: DataFrame, risk: DataFrame) -> DataFrame:
    """Overview rows completed from the risk rows of the same state."""
    other = risk.select("state", F.col("projects").alias("__projects"), "low", "moderate", F.col("high").alias("__high"),
                        F.col("critical").alias("__critical"), F.col("average_90d_risk").alias("__average"))
    zero = F.lit(0).cast("bigint")
    return overview.join(other, "state", "left").select(
        "state", F.coalesce("ongoing_projects", "__projects", zero).alias("ongoing_projects"),
        F.coalesce("high_risk_projects", "__high", zero).alias("high_risk_projects"),
        F.coalesce("critical_projects", "__critical", zero).alias("critical_projects"),
        F.coalesce("average_90d_risk", "__average").alias("average_90d_risk"), "low", "moderate",
    )


def observed_duration(snapshots: DataFrame) -> DataFrame:
    """Days from first to latest snapshot per project."""
    span = F.datediff(F.max("snapshot_date"), F.min("snapshot_date"))
    return snapshots.groupBy("project_id").agg(row_count().alias("snapshots"), span.alias("observed_days"))
